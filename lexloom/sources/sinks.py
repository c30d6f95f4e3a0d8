"""Sinks: JSONL, replace by key, append with checks, word lists with headers, split files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def replace_by(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose keys don't occur in the new ones, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_values(old: DataFrame, new: DataFrame, column: str, values: list) -> DataFrame:
    """Old rows without these values (null stays), and the new rows."""
    return old.where(~F.coalesce(F.col(column).isin(values), F.lit(False))).unionByName(new, allowMissingColumns=True)


def new_sources(incoming: DataFrame, existing: DataFrame, column: str = "source") -> DataFrame:
    """Incoming rows of sources that aren't there yet."""
    return incoming.join(existing.select(column).where(F.col(column).isNotNull()).distinct(), column, "left_anti")


def valid_suggestions(df: DataFrame) -> DataFrame:
    """Suggestions with a word and a translation, stripped."""
    from lexloom.functions.strings import strip

    s = df.withColumn("word", strip(F.col("word"))).withColumn("translation", strip(F.col("translation")))
    return s.where("word <> '' and translation <> ''")


def word_file(words: DataFrame, header: str, column: str = "word") -> DataFrame:
    """(value): comment header, then the words in order."""
    head = words.sparkSession.createDataFrame([(0, f"# {header}")], "o int, value string")
    rows = words.select(F.lit(1).alias("o"), F.col(column).alias("value"))
    return head.unionByName(rows).orderBy("o", "value").select("value")


def write_words(words: DataFrame, path: str, header: str) -> None:
    word_file(words, header).coalesce(1).write.mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(column).json(path)


def write_by_source(df: DataFrame, path: str, column: str = "source") -> None:
    """Overwrites only the sources that the rows have."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def report(counts: DataFrame, label: str, n: str) -> DataFrame:
    """(line): 'label: count' in descending order."""
    return counts.orderBy(F.desc(n), label).select(F.concat_ws(": ", F.coalesce(label, F.lit("-")), F.col(n).cast("string")).alias("line"))
