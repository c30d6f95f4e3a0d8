"""Line-based sources: JSONL with comments and bad lines, word lists, JSON objects, script literals.

Every reader works on a DataFrame with a column ``value`` of text, so the same code serves
files (``spark.read.text``), tables and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import strings as S


def content(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor comments."""
    return lines.where(~F.col("value").rlike("^\\s*(#|$)"))


def jsonl(lines: DataFrame, schema: str | T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields of JSON lines; blank lines, comments and broken lines are skipped."""
    text = schema if isinstance(schema, str) else schema.simpleString()
    row = F.from_json("value", text, {"mode": "PERMISSIVE"})
    shape = F.col("value").rlike("(?s)^\\s*\\{.*\\}\\s*$")
    return content(lines).where(shape).select(*keep, row.alias("r")).where("r is not null").select(*keep, "r.*")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return jsonl(spark.read.text(path), schema)


def jsonl_strict(lines: DataFrame, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """As ``jsonl``, but a broken line is an error when it is read."""
    return content(lines).select(*keep, F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select(*keep, "r.*")


def word_list(lines: DataFrame, lower: bool = True) -> DataFrame:
    """(word), each once."""
    w = S.strip(F.col("value"))
    w = F.lower(w) if lower else w
    return content(lines).select(w.alias("word")).where("word <> ''").distinct()


def json_map(docs: DataFrame, key: str = "key", value: str = "value", kind: str = "string") -> DataFrame:
    """(key, value) of whole documents that are one JSON object."""
    return docs.select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias(key, value))


def ngram_model(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unigrams w, c), (bigrams w1, w2, c) and (total_tokens) of model documents."""
    m = docs.select(F.from_json("value", "totalTokens bigint, unigrams map<string,bigint>, bigrams map<string,bigint>").alias("m"))
    uni = m.select(F.explode("m.unigrams").alias("w", "c"))
    bi = m.select(F.explode("m.bigrams").alias("p", "c")).select(F.split("p", " ")[0].alias("w1"), F.split("p", " ")[1].alias("w2"), "c")
    return uni, bi, m.select(F.col("m.totalTokens").alias("total_tokens"))


def literal_array(c: Column, name: str, schema: str) -> Column:
    """Rows of a script's ``var name = [...]`` with trailing commas."""
    body = F.regexp_extract(c, f"(?s)var\\s+{name}\\s*=\\s*(\\[.*\\])\\s*;?\\s*$", 1)
    return F.from_json(S.fix_literal(body), f"array<struct<{schema}>>")


def read_documents(spark: SparkSession, path: str, larger_than: int = 100) -> DataFrame:
    """(slug, size, text) of text files above a size, one row per file."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.col("length") > larger_than).select(F.regexp_extract("path", "([^/]+?)(?:\\.[^./]*)?$", 1).alias("slug"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


def sniff(content_col: Column) -> Column:
    """File format by its first bytes."""
    head = F.hex(F.substring(content_col, 1, 4))
    return F.when(head == "25504446", "pdf").when(head == "41542654", "djvu").when(head.startswith("504B"), "zip").when(head.isin("FFD8FFE0", "FFD8FFE1"), "jpeg").when(head == "89504E47", "png").otherwise("unknown")


def _high(charset: str) -> str:
    """The upper 128 characters of a one-byte encoding; unused bytes stand for themselves."""
    out = []
    for b in range(128, 256):
        try:
            out.append(bytes([b]).decode(charset))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


_LATIN = "".join(map(chr, range(128, 256)))


def decoded(content_col: Column, charset: str) -> Column:
    """Text of a one-byte legacy encoding, by a character table inside the JVM."""
    return F.translate(F.decode(content_col, "ISO-8859-1"), _LATIN, _high(charset))


def encoded(text_col: Column, charset: str) -> Column:
    """The inverse of ``decoded``."""
    return F.encode(F.translate(text_col, _high(charset), _LATIN), "ISO-8859-1")
