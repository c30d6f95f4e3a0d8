"""Dictionary checks: known forms by stemming, suggestions by edit distance, context warnings, word cards.

Forms are generated from the distinct words of the texts and looked up by equi-joins, so
the cost follows the vocabulary, not the text; candidates for suggestions are found
through deletion neighbourhoods, not by comparing every word with every other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import profile as P
from lexloom.functions import strings as S
from lexloom.functions import words as W


def _literal(pairs: list[tuple]) -> Column:
    return F.array(*[F.struct(*[F.lit(x).alias(f"c{k}") for k, x in enumerate(row)]) for row in pairs])


_SUFFIX = [(i, s) for i, s in enumerate(P.SUFFIXES)]


def suffix_stems(word: Column, least: int = 2) -> Column:
    """(idx, stem) for every ending of the list that the word has, if enough is left."""
    found = F.filter(_literal(_SUFFIX), lambda x: word.endswith(x["c1"]) & (F.length(word) - F.length(x["c1"]) >= least))
    return F.transform(found, lambda x: F.struct(x["c0"].alias("idx"), F.substring(word, F.lit(1), F.length(word) - F.length(x["c1"])).alias("stem")))


def bare_forms(word: Column) -> Column:
    """The word after each verbal prefix that it has, if more than two letters are left."""
    found = F.filter(F.array(*[F.lit(p) for p in P.PREFIXES]), lambda p: word.startswith(p) & (F.length(word) > F.length(p) + 2))
    return F.transform(found, lambda p: F.substring(word, F.length(p) + 1, F.length(word)))


def class_forms(word: Column) -> Column:
    """The word with each other class consonant."""
    out = F.array().cast("array<string>")
    for c, others in P.CLASS_CHANGES.items():
        out = F.when(F.substring(word, 1, 1) == c, F.array(*[F.concat(F.lit(o), F.substring(word, F.lit(2), F.length(word))) for o in others])).otherwise(out)
    return out


def ablaut_forms(word: Column) -> Column:
    """Nominatives of stems with changed vowel."""
    stems = F.transform(suffix_stems(word), lambda x: x["stem"])
    stems = F.concat(stems, F.transform(F.filter(stems, lambda s: s.endswith("а")), lambda s: F.substring(s, F.lit(1), F.length(s) - 1)))
    back = F.create_map(*[x for nominative, oblique in P.ABLAUT.items() for x in (F.lit(oblique), F.lit(nominative))])
    return F.filter(F.transform(stems, lambda s: F.try_element_at(back, s)), lambda x: x.isNotNull())


def candidates(words: DataFrame) -> DataFrame:
    """(word, step, idx, form): every form whose presence in the dictionary makes the word known.

    Steps: 0 the word, 1 endings, 2 prefixes (then endings), 3 class consonants (then endings), 4 changed vowels.
    """
    w = F.col("word")

    def forms(step: int, arr: Column, with_endings: bool) -> Column:
        own = F.transform(arr, lambda x, i: F.struct(F.lit(step).alias("step"), i.alias("idx"), x.alias("form")))
        if not with_endings:
            return own
        ends = F.flatten(F.transform(arr, lambda x: F.transform(suffix_stems(x), lambda y: F.struct(F.lit(step).alias("step"), (y["idx"] + 100).alias("idx"), y["stem"].alias("form")))))
        return F.concat(own, ends)

    endings = F.transform(suffix_stems(w), lambda x: F.struct(F.lit(1).alias("step"), x["idx"].alias("idx"), x["stem"].alias("form")))
    every = F.concat(forms(0, F.array(w), False), endings, forms(2, bare_forms(w), True), forms(3, class_forms(w), True), forms(4, ablaut_forms(w), False))
    return words.select("word", F.explode(every).alias("c")).select("word", "c.step", "c.idx", "c.form")


def known(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, step, stem): each known word with its first rule and what that rule found."""
    hits = candidates(words).join(dictionary.select(F.col("word").alias("form")), "form")
    return hits.groupBy("word").agg(F.min(F.struct("step", "idx", "form")).alias("m")).select("word", "m.step", F.col("m.form").alias("stem"))


def deletions(c: Column, k: int) -> Column:
    """The string with up to ``k`` letters left out, each variant once."""
    out = F.array(c)
    for _ in range(k):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda s: F.when(F.length(s) > 1, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array(F.lit("")))))))
    return out


def near(unknown: DataFrame, dictionary: DataFrame, k: int = 2) -> DataFrame:
    """(word, candidate, distance): all dictionary words within ``k`` edits.

    Words within k edits share a variant with up to k letters left out, so the join is on
    variants and the bounded distance decides.
    """
    a = unknown.select("word", F.explode(deletions(F.col("word"), k)).alias("v"))
    b = dictionary.select(F.col("word").alias("candidate"), F.explode(deletions(F.col("word"), k)).alias("v"))
    met = a.join(b, "v").select("word", "candidate").distinct()
    return met.withColumn("distance", F.levenshtein("word", "candidate", k)).where("distance >= 0")


def suggestions(unknown: DataFrame, dictionary: DataFrame, freq: DataFrame, translations: DataFrame, k: int = 2, most: int = 5) -> DataFrame:
    """(word, rank, candidate, translation): nearest first, then the more frequent."""
    j = near(unknown, dictionary, k).join(freq.select(F.col("word").alias("candidate"), "freq"), "candidate", "left")
    w = Window.partitionBy("word").orderBy("distance", F.desc(F.coalesce("freq", F.lit(0))), "candidate")
    top = j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return top.join(translations.select(F.col("word").alias("candidate"), "translation"), "candidate", "left").select("word", "rank", "candidate", "translation")


def text_words(texts: DataFrame, key: str, col: str) -> DataFrame:
    """(key, position, word): white-space words, palochkas in one spelling, only letters, lower case."""
    pos = texts.select(key, F.explode(W.positioned_words(S.normalize_palochka(F.col(col)))).alias("w"))
    return pos.select(key, F.col("w.position").alias("position"), F.lower(S.strip_punctuation(F.col("w.word"))).alias("word")).where("word <> ''")


def check(texts: DataFrame, key: str, col: str, dictionary: DataFrame, freq: DataFrame, translations: DataFrame) -> DataFrame:
    """(key, position, word, suggestions): unknown words, each distinct one looked up once."""
    words = text_words(texts, key, col)
    distinct = words.select("word").distinct()
    unknown = distinct.join(known(distinct, dictionary).select("word"), "word", "left_anti")
    s = suggestions(unknown, dictionary, freq, translations).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate", "translation"))).alias("suggestions"))
    return words.join(unknown.join(s, "word", "left"), "word").select(key, "position", "word", "suggestions")


def context(texts: DataFrame, key: str, col: str, unigrams: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(key, position, bigram, score): neighbours that were expected at least once and never seen."""
    d = texts.select(key, W.positioned_words(S.normalize_palochka(F.lower(F.col(col)))).alias("__w")).where(F.size("__w") > 1)
    n = F.size("__w") - 1
    pairs = F.arrays_zip(F.slice("__w", F.lit(1), n).alias("a"), F.slice("__w", F.lit(2), n).alias("b"))
    b = d.select(key, F.explode(pairs).alias("p")).select(key, F.col("p.a.position").alias("position"), F.col("p.a.word").alias("w1"), F.col("p.b.word").alias("w2"))
    u1, u2 = unigrams.select(F.col("word").alias("w1"), F.col("n").alias("f1")), unigrams.select(F.col("word").alias("w2"), F.col("n").alias("f2"))
    totals = F.broadcast(unigrams.agg(F.sum("n").cast("double").alias("total"), F.count("*").alias("vocabulary")))  # one row
    j = b.join(u1, "w1").join(u2, "w2").crossJoin(totals).where(F.col("f1") * F.col("f2") / F.col("total") >= 1.0)
    j = j.join(bigrams.select("w1", "w2"), ["w1", "w2"], "left_anti")
    return j.select(key, "position", F.concat_ws(" ", "w1", "w2").alias("bigram"), (F.lit(1.0) / (F.col("f1") + F.col("vocabulary"))).alias("score"))


def laplace(c12: Column, c1: Column, vocabulary: Column) -> Column:
    return (c12 + 1) / (c1 + vocabulary)


def expected(f1: Column, f2: Column, total: Column) -> Column:
    return f1 * f2 / total


def related_words(word: DataFrame, dictionary: DataFrame, most: int) -> DataFrame:
    """(word, related, rank): words with the same first four letters, shortest first.

    One more than ``most`` of each beginning are enough, as a word is not related to itself, so
    the join makes no more rows than that for a word, however many share its beginning.
    """
    order = (F.length("related"), F.col("related"))
    d = dictionary.select(F.col("word").alias("related"), F.substring("word", 1, 4).alias("p")).distinct()
    heads = d.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy(*order))).where(F.col("k") <= most + 1).drop("k")
    j = word.select("word", F.substring("word", 1, 4).alias("p")).join(heads, "p").where("word <> related")
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(*order))).where(F.col("rank") <= most).select("word", "related", "rank")


def word_card(word: DataFrame, freq: DataFrame, translations: DataFrame, dictionary: DataFrame, related: int = 6) -> DataFrame:
    """(word, freq, translation, related): related words share the first four letters, shortest first."""
    j = related_words(word, dictionary, related)
    top = j.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "related"))), lambda x: x["related"]), "|").alias("related"))
    return word.join(freq, "word", "left").join(translations, "word", "left").join(top, "word", "left").select("word", F.coalesce("freq", F.lit(0)).alias("freq"), F.coalesce("translation", F.lit("")).alias("translation"), F.coalesce("related", F.lit("")).alias("related"))
