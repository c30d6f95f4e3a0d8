"""Tokens, segments and sentences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import profile as P
from .strings import strip, sub

_W = P.WS


def positioned_words(c: Column) -> Column:
    """(position, word) of white-space words; a leading blank shifts the positions, as empty words count."""
    return F.filter(F.transform(F.split(c, "[ \\t\\n\\x0B\\f\\r]+"), lambda w, i: F.struct(i.alias("position"), w.alias("word"))), lambda x: x["word"] != "")


def model_words(c: Column) -> Column:
    """Words for counting: lower case, two letters or more before hyphens are stripped."""
    found = F.filter(F.regexp_extract_all(F.lower(c), F.lit("([а-яёӏ][а-яёӏ\\-]*)"), 1), lambda w: F.length(w) >= 2)
    return F.filter(F.transform(found, lambda w: sub(w, "^-+|-+$")), lambda w: w != "")


def letter_words(c: Column, least: int = 2) -> Column:
    return F.regexp_extract_all(c, F.lit(f"([а-яёӏА-ЯЁӀ]{{{least},}})"), 1)


def paragraphs(c: Column, longer_than: int = P.MIN_SEGMENT) -> Column:
    return F.filter(F.transform(F.split(c, "\\n{2,}"), strip), lambda p: F.length(p) > longer_than)


def segments(c: Column, least: int = P.MIN_SEGMENT, most: int = P.MAX_SEGMENT) -> Column:
    """Paragraphs packed up to ``most`` characters; a longer one is packed by sentences."""
    parts = F.filter(F.transform(F.split(c, "\\n{2,}"), strip), lambda p: F.length(p) >= least)
    pieces = F.flatten(
        F.transform(
            parts,
            lambda p: F.when(
                F.length(p) > most,
                F.transform(F.filter(F.split(p, f"(?<=[.!?])[{_W}\\n]+"), lambda s: F.length(s) >= least), lambda s: F.struct(s.alias("t"), F.lit(" ").alias("glue"))),
            ).otherwise(F.array(F.struct(p.alias("t"), F.lit("\n\n").alias("glue")))),
        )
    )
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, x: Column) -> Column:
        now, t = acc["now"], x["t"]
        joined = F.when(now == "", t).otherwise(F.concat(now, x["glue"], t))
        fits = F.length(now) + F.length(t) < most
        done = F.when(fits | (now == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(strip(now))))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(t).alias("now"))

    return F.aggregate(pieces, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(strip(a["now"])))))


_END = "(?<=[^А-ЯA-Z\\d])[.!?…]+(?=\\s+[А-ЯA-ZЁ«\"“]|$)"


def _flow(c: Column, header: str) -> Column:
    """Lines joined; headings by rule: 'short' (two words, figures or capitals), 'caps' (eight words in capitals), 'none'."""
    lines = F.filter(F.transform(F.split(sub(F.replace(c, F.lit("\u00ad"), F.lit("")), "-\\n"), "\n"), strip), lambda x: x != "")
    words = lambda x: F.size(F.split(x, "\\s+"))
    caps = lambda x: (x == F.upper(x)) & x.rlike("\\p{L}")
    if header == "short":
        lines = F.filter(lines, lambda x: ~((words(x) <= 2) & (x.rlike("^\\d+$") | caps(x))))
    elif header == "caps":
        lines = F.filter(lines, lambda x: ~((words(x) <= 8) & caps(x)))
    return F.array_join(lines, " ")


def sentences_joined(c: Column, longer_than: int = 10, header: str = "short") -> Column:
    """Over line ends; the terminator is consumed."""
    return F.filter(F.transform(F.split(_flow(c, header), _END), strip), lambda s: F.length(s) > longer_than)


def sentences_by_line(c: Column, least: int = 15) -> Column:
    """Each line by itself; the terminator is consumed."""
    text = sub(F.replace(c, F.lit("\u00ad"), F.lit("")), "-\\n")
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.filter(F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, _END), strip))), lambda s: F.length(s) >= least)


def sentences_kept(c: Column, least: int = 15) -> Column:
    """The terminator stays."""
    flat = strip(sub(c, f"[{_W}\\n]+", " "))
    return F.filter(F.transform(F.split(flat, "(?<=[.!?»])\\s+(?=[А-ЯЁ«\\d\"])"), strip), lambda s: F.length(s) >= least)


def numbered_sections(c: Column, least: int = 30) -> Column:
    """(number, body) of sections that open with a number on a line of its own."""
    parts = F.split(c, "(?m)(?=^\\s*\\d{1,3}\\.?\\s*$)")
    made = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^\\s*(\\d{1,3})\\.?\\s*(?:\\n|$)", 1).try_cast("int").alias("num"), strip(sub(p, "^\\s*\\d{1,3}\\.?\\s*(?:\\n|$)")).alias("body")))
    return F.filter(made, lambda x: x["num"].isNotNull() & (F.length(x["body"]) >= least))


def blocks(c: Column) -> Column:
    """Blank-line blocks, broken words joined, one line each."""
    return F.filter(F.transform(F.split(sub(c, "-\\n"), "\\n[ \\t]*\\n"), lambda b: strip(sub(b, "\\s+", " "))), lambda b: b != "")


def language_score(c: Column) -> Column:
    """Share of words with a marker of the language; 0 without Cyrillic words."""
    w = letter_words(c)
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.size(F.filter(w, lambda x: x.rlike(f"(?iu){P.MARKERS}"))) / F.size(w))


def classify(c: Column) -> Column:
    """other, ing, mixed or rus, by the share of Cyrillic letters and of marked words."""
    share = F.length(sub(c, "[^а-яёА-ЯЁ]")) / F.greatest(F.length(c), F.lit(1))
    score = language_score(c)
    return F.when(c.isNull(), None).when(share < 0.3, "other").when(score >= 0.25, "ing").when(score >= P.MIN_SCORE, "mixed").otherwise("rus")
