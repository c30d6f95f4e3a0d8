"""Queries over the linguistic operators (L03-L18), composites (C), streams (R) and what only rows can check (A18, G11)."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions import profile as P
from lexloom.functions import strings as S
from lexloom.functions import words as W
from lexloom.operators import align as AL
from lexloom.operators import filters as O
from lexloom.operators import relations as R
from lexloom.operators import spelling as SP
from lexloom.streaming import buckets as B

from . import relational_queries as Q
from .base import Catalogue, lit, s_replace, s_strip, s_sub, table
from .function_queries import C_MODEL_WORDS, CLASS_SQL, SCORE_SQL
from .function_queries import SQL as FUNCTION_SQL

C = Catalogue()
PAR = "parallel_ing_rus"
_DICT, TR, CW = Q._DICT, Q.TR_SQL, Q._CW
_SUF = "(values " + ", ".join(f"({i}, {lit(s)})" for i, s in enumerate(P.SUFFIXES)) + ") s(idx, suf)"
_PRE = "(values " + ", ".join(f"({i}, {lit(p)})" for i, p in enumerate(P.PREFIXES)) + ") p(idx, pre)"
_CLS = "(values " + ", ".join(f"({lit(c)}, {i}, {lit(o)})" for c, os in P.CLASS_CHANGES.items() for i, o in enumerate(os)) + ") k(c, idx, o)"
_ABL = "(values " + ", ".join(f"({lit(n)}, {lit(o)})" for n, o in P.ABLAUT.items()) + ") a(nom, obl)"
_W = f"(select word from {_DICT})"
_D = f"(select word from {TR})"


def _stems(src: str, col: str, keep: str) -> str:
    return f"select {keep}, s.idx, substring({col}, 1, length({col}) - length(s.suf)) as form from {src} join {_SUF} on ends_with({col}, s.suf) and length({col}) - length(s.suf) >= 2"


_PREF = f"(select w.word, p.idx as pidx, substring(w.word, length(p.pre) + 1) as bare from {_W} w join {_PRE} on starts_with(w.word, p.pre) and length(w.word) > length(p.pre) + 2)"
_CLSF = f"(select w.word, k.idx as kidx, concat(k.o, substring(w.word, 2)) as alt from {_W} w join {_CLS} on substring(w.word, 1, 1) = k.c)"
_L03 = f"select word, 1 as step, form from ({_stems(_W, 'word', 'word')}) where form in {_D}"
_L04 = f"select word, form from (select word, bare as form from {_PREF} union all select word, form from ({_stems(_PREF, 'bare', 'word, bare')})) where form in {_D}"
_L05 = f"select word, form from (select word, alt as form from {_CLSF} union all select word, form from ({_stems(_CLSF, 'alt', 'word, alt')})) where form in {_D}"
_ST = f"({_stems(_W, 'word', 'word')})"
_L06 = f"select x.word, a.nom as form from (select word, form from {_ST} union all select word, substring(form, 1, length(form) - 1) from {_ST} where ends_with(form, 'а')) x join {_ABL} on x.form = a.obl where a.nom in {_D}"


def words(spark, d):
    return Q.dictionary(spark, d)


def base(spark, d):
    return Q.translations(spark, d).select("word")


def by_step(step: int):
    def run(spark, d):
        c = SP.candidates(words(spark, d)).where(F.col("step") == step)
        return c.join(base(spark, d).select(F.col("word").alias("form")), "form").select("word", "form").distinct()

    return run


C.add("L03_suffix_stems", f"select distinct word, form from ({_L03})")(by_step(1))
#: Words with a prefix, and with a changed vowel, that the tables have none of.
_PREFIXED = f"(select word from {_W} union select concat(p.pre, t.word) from {_PRE} cross join {TR} t)"
_CHANGED = ("балаш", "ламага", "биерага", "биераш", "тамара", "балаша")


@C.add("L04_prefix_forms", f"select distinct word, form from ({_L04.replace(_W, _PREFIXED)})")
def l04(spark, d):
    prefixes = spark.createDataFrame([(p,) for p in P.PREFIXES], "pre string")
    made = base(spark, d).crossJoin(F.broadcast(prefixes)).select(F.concat("pre", "word").alias("word"))  # nine prefixes
    c = SP.candidates(words(spark, d).select("word").unionByName(made).distinct()).where("step = 2")
    return c.join(base(spark, d).select(F.col("word").alias("form")), "form").select("word", "form").distinct()


C.add("L05_class_forms", f"select distinct word, form from ({_L05})")(by_step(3))


@C.add("L06_ablaut_forms", "select distinct word, form from (" + _L06.replace(_W, f"(select word from {_W} union select unnest({list(_CHANGED)}))").replace(_D, f"(select word from {TR} union select unnest({list(P.ABLAUT)}))") + ")")
def l06(spark, d):
    own = [spark.createDataFrame([(w,) for w in x], "word string") for x in (_CHANGED, tuple(P.ABLAUT))]
    c = SP.candidates(words(spark, d).select("word").unionByName(own[0]).distinct()).where("step = 4")
    return c.join(base(spark, d).unionByName(own[1]).distinct().select(F.col("word").alias("form")), "form").select("word", "form").distinct()


_KNOWN = f"(select word from {_W} where word in {_D} union select word from ({_L03}) union select word from ({_L04}) union select word from ({_L05}) union select word from ({_L06}))"


@C.add("L07_known_forms", f"select word from {_KNOWN}")
def l07(spark, d):
    return SP.known(words(spark, d), base(spark, d)).select("word")


@C.add("L08_stem", f"select word, coalesce(list_extract(list(form order by idx), 1), word) as stem from (select w.word, x.form, x.idx from {_W} w left join (select word, form, idx from ({_stems(_W, 'word', 'word')}) where form in {_D}) x using (word)) group by word")
def l08(spark, d):
    ends = SP.candidates(words(spark, d)).where("step = 1").join(base(spark, d).select(F.col("word").alias("form")), "form")
    best = ends.groupBy("word").agg(F.min_by("form", "idx").alias("stem"))
    return words(spark, d).join(best, "word", "left").select("word", F.coalesce("stem", "word").alias("stem"))


C.add("L09_bounded_distance", f"select c.word, t.word as candidate, {Q.LEV} as distance from {CW} c, {TR} t where {Q.LEV} <= 2")(
    lambda spark, d: SP.near(table(spark, d, "common_words").where("length(word) > 2 and lang <> 'eng'").select("word").distinct(), base(spark, d))
)

_UNI = f"(select word, count(*) as n from (select unnest({C_MODEL_WORDS.format('ing')}) word from {PAR}) group by word)"


@C.add("L10_expected", f"select b.w1, b.w2, round(u1.n * u2.n / cast((select sum(n) from {_UNI}) as double), 6) as expected from (select distinct w1, w2 from {Q._BI}) b join {_UNI} u1 on u1.word = b.w1 join {_UNI} u2 on u2.word = b.w2")
def l10(spark, d):
    uni = unigrams(spark, d)
    b = Q.bigrams(table(spark, d, PAR), "pair_id", "ing").select("w1", "w2").distinct()
    j = b.join(uni.select(F.col("word").alias("w1"), F.col("n").alias("f1")), "w1").join(uni.select(F.col("word").alias("w2"), F.col("n").alias("f2")), "w2")
    total = uni.agg(F.sum("n").alias("total"))
    return j.crossJoin(F.broadcast(total)).select("w1", "w2", F.round(SP.expected(F.col("f1"), F.col("f2"), F.col("total").cast("double")), 6).alias("expected"))  # one row


def unigrams(spark, d):
    return table(spark, d, PAR).select(F.explode(W.model_words(F.col("ing"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@C.add("L11_laplace", f"select b.w1, b.w2, round((b.n + 1) / cast(u.n + (select count(*) from {_UNI}) as double), 9) as p from (select w1, w2, count(*) n from {Q._BI} group by w1, w2) b join {_UNI} u on u.word = b.w1")
def l11(spark, d):
    uni = unigrams(spark, d)
    b = Q.bigrams(table(spark, d, PAR), "pair_id", "ing").groupBy("w1", "w2").agg(F.count("*").alias("n12"))
    v = uni.agg(F.count("*").alias("v"))
    return b.join(uni.withColumnRenamed("word", "w1"), "w1").crossJoin(F.broadcast(v)).select("w1", "w2", F.round(SP.laplace(F.col("n12"), F.col("n"), F.col("v")), 9).alias("p"))  # one row


C.add("L12_cosine", Q.SQL["J19_pair_cosine"])(Q.j19)


def _sides(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 10).cast("bigint").alias("doc"), (F.col("vec_id") % 2).cast("int").alias("side"), F.floor((F.col("vec_id") % 10) / 2).cast("int").alias("idx"), "embedding")


@C.add("L13_band_alignment")
def l13(spark, d):
    return AL.align_vectors(_sides(spark, d), "doc", "side", "idx", "embedding", threshold=-1.0).withColumn("score", F.round("score", 5))


@C.add("L14_length_alignment")
def l14(spark, d):
    t = table(spark, d, PAR).where("ing is not null and rus is not null")
    return AL.align_lengths(t.select("pair_id", W.sentences_kept(F.col("ing")).alias("a"), W.sentences_kept(F.col("rus")).alias("b")), "pair_id", "a", "b")


@C.add("L15_window_policy", "select doc_id, greatest(8, greatest(n, m) // 6) as ratio, greatest(4, n // 4) as quarter, greatest(6, n // 5) as fifth from (select doc_id, coalesce(n_chars, 0) n, coalesce(length(source), 0) m from documents)")
def l15(spark, d):
    n, m = F.coalesce("n_chars", F.lit(0)), F.coalesce(F.length("source"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.greatest(F.lit(8), F.floor(F.greatest(n, m) / 6)).alias("ratio"), F.greatest(F.lit(4), F.floor(n / 4)).alias("quarter"), F.greatest(F.lit(6), F.floor(n / 5)).alias("fifth"))


@C.add("L16_thresholds", "select mono_id, lang_score >= 0.25 as t25, lang_score >= 0.30 as t30, lang_score >= 0.35 as t35 from mono where lang_score is not null")
def l16(spark, d):
    s = F.col("lang_score")
    return table(spark, d, "mono").where(s.isNotNull()).select("mono_id", (s >= 0.25).alias("t25"), (s >= 0.30).alias("t30"), (s >= 0.35).alias("t35"))


@C.add("L17_embedding_seam", "select vec_id, round(sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))), 4) as norm from embeddings")
def l17(spark, d):
    """Vectors come from outside; here their norms are checked."""
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(R.dot(e, e)), 4).alias("norm"))


@C.add("L18_translation_seam", f"select w.word, coalesce(t.translation, w.word) as translation from {_DICT} w left join {TR} t using (word)")
def l18(spark, d):
    """The call of a translation model, here the dictionary."""
    return words(spark, d).join(Q.translations(spark, d), "word", "left").select("word", F.coalesce("translation", "word").alias("translation"))


_CH, _VN = "string_split(verse_ref, ':')[1]", "string_split(verse_ref, ':')[2]"


@C.add("G11_parse_verses")
def g11(spark, d):
    """Pages of one verse, whatever its text, under the running head of its chapter; a head counts from a verse of five or less on."""
    v = table(spark, d, PAR).where("verse_ref is not null")
    ref = F.split("verse_ref", ":")
    page = F.concat(F.lit("КОРТА "), F.get(ref, F.lit(0)), F.lit("\n"), F.get(ref, F.lit(1)), F.lit(". "), F.regexp_replace("ing", "^[\\s\\p{Z}]+", ""))
    return AL.parse_verses(v.select("pair_id", page.alias("t")), "pair_id", "t", "КОРТ[АН]*")


# ---- composites


@C.add("C01_mono_dataset", f"""
select doc_id, n, text, cls as lang, round_even(score, 3) as lang_score, length(text) as chars
from (select doc_id, n, text, {CLASS_SQL} as cls, {SCORE_SQL} as score from (select doc_id, n, segment as text from ({FUNCTION_SQL['G05_segments']})))
where cls in ('ing', 'mixed') and score >= 0.05""")
def c01(spark, d):
    """(doc_id, n, text, lang, lang_score, chars) of the segments in the language or mixed."""
    s = table(spark, d, "documents").select("doc_id", F.posexplode(W.segments(F.col("text"))).alias("n", "text")).withColumn("n", F.col("n").cast("bigint"))
    s = s.withColumn("score", W.language_score(F.col("text"))).withColumn("lang", W.classify(F.col("text")))
    return s.where(F.col("lang").isin("ing", "mixed") & (F.col("score") >= P.MIN_SCORE)).select("doc_id", "n", "text", "lang", F.bround("score", 3).alias("lang_score"), F.length("text").alias("chars"))


@C.add("C02_parallel_dataset", f"select word as ing, translation as rus, 'word_pair' as pair_type from {TR} union all select ing, rus, 'bilingual_para' from ({Q.SQL['W03_greedy_pairs']})")
def c02(spark, d):
    a = Q.translations(spark, d).select(F.col("word").alias("ing"), F.col("translation").alias("rus"), F.lit("word_pair").alias("pair_type"))
    return a.unionByName(Q.w03(spark, d).select("ing", "rus", F.lit("bilingual_para").alias("pair_type")))


_FIX = lambda c: s_strip(s_sub(s_sub(s_replace(c, P.ENTITIES), "<[^>]{1,30}>", " "), "[ \\t]+", " "))


def clean_pass(spark, d, least=15):
    p = table(spark, d, PAR).select("pair_id", S.fix_html(F.coalesce("ing", F.lit(""))).alias("ing"), S.fix_html(F.coalesce("rus", F.lit(""))).alias("rus"))
    short = (F.length("ing") < least) | (F.length("rus") < least)
    kept = p.where(~short)
    first = kept.groupBy("ing").agg(F.min(F.struct("pair_id", "rus")).alias("m"))  # combined before the shuffle, so repeated texts are cheap
    return p, short, kept, first.select("m.pair_id", "ing", "m.rus")


_CLEAN = f"(select pair_id, {_FIX('coalesce(ing, ' + lit('') + ')')} as ing, {_FIX('coalesce(rus, ' + lit('') + ')')} as rus from {PAR})"


@C.add("C03_clean_pass", f"select pair_id, ing, rus from (select *, row_number() over (partition by ing order by pair_id) n from {_CLEAN} where length(ing) >= 15 and length(rus) >= 15) where n = 1")
def c03(spark, d):
    return clean_pass(spark, d)[3]


@C.add("C03_clean_counts", f"with c as (select * from {_CLEAN}), k as (select count(*) n, count(distinct ing) u from c where length(ing) >= 15 and length(rus) >= 15) select (select count(*) from c) - n as too_short, n - u as duplicate, u as kept from k")
def c03b(spark, d):
    p, short, kept, clean = clean_pass(spark, d)
    return p.agg(F.count_if(short).alias("too_short"), F.count_if(~short).alias("n")).crossJoin(kept.agg(F.countDistinct("ing").alias("kept"))).select("too_short", (F.col("n") - F.col("kept")).alias("duplicate"), "kept")


@C.add("C04_rescore", "select vec_id, verdict from (select a.vec_id, case when a.label = 1 then 'verse' when list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.1 then 'kept' else 'removed' end as verdict from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)")
def c04(spark, d):
    return rescored(spark, d, 0.1)


def rescored(spark, d, threshold: float):
    e = table(spark, d, "embeddings")
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o")), "vec_id")
    return j.select("vec_id", F.when(F.col("label") == 1, "verse").when(R.dot(F.col("embedding"), F.col("o")) >= threshold, "kept").otherwise("removed").alias("verdict"))


@C.add("C04_rescore_default", "select vec_id, verdict from (select a.vec_id, case when a.label = 1 then 'verse' when list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.25 then 'kept' else 'removed' end as verdict from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)")
def c04_default(spark, d):
    """With the documented threshold."""
    return rescored(spark, d, 0.25)


@C.add("C05_prepare", f"""
with k as (select pair_id, ing, rus from {PAR} where trim(coalesce(ing, '')) <> '' and trim(coalesce(rus, '')) <> ''),
r as (select *, row_number() over (order by md5('42|' || pair_id), pair_id) i, count(*) over () n from k), s as (select *, case when i <= greatest(100, floor(n * 5 / 100)) then 'test' when i <= 2 * greatest(100, floor(n * 5 / 100)) then 'dev' else 'train' end split from r)
select split, ing as src, rus as tgt, 'inh' as src_lang, 'ru' as tgt_lang from s union all select split, rus, ing, 'ru', 'inh' from s""")
def c05(spark, d):
    return prepare(table(spark, d, PAR), "pair_id", 42, 5, 5).drop("pair_id")


def prepare(pairs, key: str, seed: int, dev: int, test: int):
    """(key, split, src, tgt, src_lang, tgt_lang); fewer than 200 usable pairs can't be split."""
    k = pairs.where("trim(coalesce(ing, '')) <> '' and trim(coalesce(rus, '')) <> ''").select(key, "ing", "rus")
    enough = F.broadcast(k.agg(F.count("*").alias("__n")))  # one row
    k = k.crossJoin(enough).where(F.when(F.col("__n") < 200, F.raise_error(F.lit("at least 200 pairs are needed"))).otherwise(F.lit(True))).drop("__n")
    return O.both_directions(R.hashed_rank_split(k, key, seed, dev, test), [key, "split"], "ing", "rus", "inh", "ru")


@C.add("C06_train_ngram", f"select 'unigram' as kind, word as gram, n from ({Q.SQL['A01_unigrams']}) union all select 'bigram', concat(w1, ' ', w2), n from ({Q.SQL['A02_bigrams']})")
def c06(spark, d):
    a = Q.a01(spark, d).select(F.lit("unigram").alias("kind"), F.col("word").alias("gram"), "n")
    return a.unionByName(Q.a02(spark, d).select(F.lit("bigram").alias("kind"), F.concat_ws(" ", "w1", "w2").alias("gram"), "n"))


def checked(spark, d):
    """The first side of every pair as a request."""
    return table(spark, d, PAR).where("ing is not null")


_K = P.CONSONANTS
_NORM = s_sub(f"replace(ing, 'Ӏ', 'ӏ')", f"([{_K}])I", "\\1ӏ")
_NORM = s_sub(s_sub(_NORM, f"([{_K}])1([а-яёӏ])", "\\1ӏ\\2"), f"([{_K}])1([а-яёӏ])", "\\1ӏ\\2")
_SPLIT = f"string_split_regex({_NORM}, '[ \\t\\n\\x0B\\f\\r]+')"
_CHECK = f"(select pair_id, position, lower(regexp_replace(w, '[^\\pLӏ]', '', 'g')) as word from (select pair_id, generate_subscripts({_SPLIT}, 1) - 1 as position, unnest({_SPLIT}) as w from {PAR} where ing is not null) where lower(regexp_replace(w, '[^\\pLӏ]', '', 'g')) <> '')"
_CW7 = f"(select distinct word from {_CHECK})"
_KN7 = _KNOWN.replace(_W, _CW7)


@C.add("C07_unknown_words", f"select pair_id, position, word from {_CHECK} where word not in {_KN7}")
def c07(spark, d):
    w = SP.text_words(checked(spark, d), "pair_id", "ing")
    distinct = w.select("word").distinct()
    return w.join(SP.known(distinct, base(spark, d)).select("word"), "word", "left_anti").select("pair_id", F.col("position").cast("bigint").alias("position"), "word")


_SUG = f"""(with u as (select distinct word from {_CHECK} where word not in {_KN7}),
j as (select c.word, t.word as cand, {Q.LEV} as dist, coalesce(f.n, 0) as freq from u c join {TR} t on abs(length(c.word) - length(t.word)) <= 2 and {Q.LEV} <= 2 left join {_UNI} f on f.word = t.word),
r as (select *, row_number() over (partition by word order by dist, freq desc, cand) rk from j) select word, string_agg(cand, '|' order by rk) as suggestions from r where rk <= 5 group by word)"""


@C.add("C07_spell_check", f"select k.pair_id, k.position, k.word, coalesce(s.suggestions, '') as suggestions from {_CHECK} k left join {_SUG} s on s.word = k.word where k.word not in {_KN7}")
def c07b(spark, d):
    """Unknown words with up to five suggestions; the distance part is checked by L09 and W04."""
    freq = unigrams(spark, d).withColumnRenamed("n", "freq")
    out = SP.check(checked(spark, d), "pair_id", "ing", base(spark, d), freq, Q.translations(spark, d))
    return out.select("pair_id", "position", "word", F.array_join(F.transform(F.coalesce("suggestions", F.array()), lambda x: x["candidate"]), "|").alias("suggestions"))


_LN = s_sub(f"replace(lower(ing), 'Ӏ', 'ӏ')", f"([{_K}])I", "\\1ӏ")
_LN = s_sub(s_sub(_LN, f"([{_K}])1([а-яёӏ])", "\\1ӏ\\2"), f"([{_K}])1([а-яёӏ])", "\\1ӏ\\2")
_LS = f"string_split_regex({_LN}, '[ \\t\\n\\x0B\\f\\r]+')"
_CTX = f"""(with w as (select pair_id, position, word from (select pair_id, generate_subscripts({_LS}, 1) - 1 as position, unnest({_LS}) as word from {PAR} where ing is not null) where word <> ''),
b as (select pair_id, position, word as w1, lead(word) over (partition by pair_id order by position) as w2 from w), u as ({Q.SQL['A01_unigrams']}), g as ({Q.SQL['A02_bigrams']})
select b.pair_id, b.position, concat(b.w1, ' ', b.w2) as bigram, round(1.0 / cast(u1.n + (select count(*) from u) as double), 9) as score from b join u u1 on u1.word = b.w1 join u u2 on u2.word = b.w2
where cast(u1.n as double) * u2.n / (select sum(n) from u) >= 1.0 and not exists (select 1 from g where g.w1 = b.w1 and g.w2 = b.w2))"""


@C.add("C08_context", f"select * from {_CTX}")
def c08(spark, d):
    uni = Q.a01(spark, d)
    return SP.context(checked(spark, d), "pair_id", "ing", uni, Q.a02(spark, d)).withColumn("score", F.round("score", 9))


@C.add("C09_full_check", f"select distinct p.pair_id, (p.pair_id in (select pair_id from {_CHECK} where word not in {_KN7}) or p.pair_id in (select pair_id from {_CTX})) as has_errors from {PAR} p where ing is not null and trim(ing) <> ''")
def c09(spark, d):
    """(pair_id, has_errors): whether a request has unknown words or unlikely neighbours; blank ones are refused."""
    t = checked(spark, d).where(F.trim("ing") != "").select("pair_id")
    bad = c07(spark, d).select("pair_id").unionByName(c08(spark, d).select("pair_id")).distinct().withColumn("e", F.lit(True))
    return t.join(bad, "pair_id", "left").select("pair_id", F.coalesce("e", F.lit(False)).alias("has_errors"))


@C.add("C10_dictionary_page", f"select word, coalesce(translation, '') as translation from (select word from {_DICT} where starts_with(word, 'г') order by word limit 50 offset 50) left join {TR} using (word)")
def c10(spark, d):
    page = words(spark, d).where(F.col("word").startswith("г")).orderBy("word").offset(50).limit(50)
    return R.lookup(page, Q.translations(spark, d), "word", "translation", "")


_REL = f"(select word, string_agg(related, '|' order by rank) as related from ({Q.SQL['J15_related_words']}) group by word)"


@C.add("C11_word_card", f"select w.word, coalesce(u.n, 0) as freq, coalesce(w.translation, '') as translation, coalesce(r.related, '') as related from {TR} w left join {_UNI} u using (word) left join {_REL} r using (word)")
def c11(spark, d):
    return SP.word_card(base(spark, d), unigrams(spark, d).withColumnRenamed("n", "freq"), Q.translations(spark, d), base(spark, d))


@C.add("C12_merge_dictionaries", f"select word, translation from {TR} where regexp_matches(word, '^[а-яёӀӏ\\-]+$') and length(word) >= 2 union all select word, '' from {_DICT} where regexp_matches(word, '^[а-яёӀӏ\\-]+$') and length(word) >= 2 and not starts_with(word, '-') and word not in (select word from {TR})")
def c12(spark, d):
    valid = F.col("word").rlike("^[а-яёӀӏ\\-]+$") & (F.length("word") >= 2)
    new = words(spark, d).where(valid & ~F.col("word").startswith("-")).withColumn("translation", F.lit(""))
    return R.merged(Q.translations(spark, d), new, ["word"]).where(valid).select("word", "translation")


@C.add("C13_clean_translations", f"select word, translation from ({Q.TRIAGE_SQL}) where verdict <> 'bad'")
def c13(spark, d):
    """The cleaned dictionary: good entries, forms with the meaning of their base, and suspects."""
    return cleaned_dictionary(Q.triage_input(spark, d), Q.translations(spark, d))


def cleaned_dictionary(pairs, known, labels=None):
    """(word, translation); suspects stay unless ``labels`` (word, label) of a reviewer has another label than G for them."""
    t = Q.triage(pairs, known)
    label = F.lit("G")
    if labels is not None:
        t = t.join(labels.select("word", "label"), "word", "left")
        label = F.coalesce("label", F.lit("G"))
    return t.where((F.col("verdict") == "good") | (F.col("verdict") == "suspect") & (label == "G")).select("word", "translation")


@C.add("C13_verdict_counts", f"select verdict, reason, count(*) as n from ({Q.TRIAGE_SQL}) group by verdict, reason")
def c13_counts(spark, d):
    return Q.triage(Q.triage_input(spark, d), Q.translations(spark, d)).groupBy("verdict", "reason").agg(F.count("*").alias("n"))


def _split(t, *more):
    return t.select("pair_id", "ing", "rus", *more, W.sentences_kept(F.col("ing")).alias("a"), W.sentences_kept(F.col("rus")).alias("b"))


@C.add("C14_align_documents")
def c14(spark, d):
    """(pair_id, ing, rus, score): sentences of both sides, made vectors and aligned in a band."""
    t = table(spark, d, PAR).where("ing is not null and rus is not null")
    return AL.align_texts(_split(t), "pair_id", "a", "b", threshold=0.35, policy="quarter").withColumn("score", F.round("score", 5))


_LONG_ENOUGH = "length(ing) > 20 and length(rus) > 20"


@C.add("C15_whole_or_aligned")
def c15(spark, d):
    """(pair_id, ing, rus, kind): poems and texts of less than four sentences whole, a side of one sentence whole, others aligned."""
    t = table(spark, d, PAR).where("ing is not null and rus is not null")
    own = _split(t, "pair_type").withColumn("short", (F.coalesce("pair_type", F.lit("")) == "poem") | (F.size("a") < 4))
    whole = own.where(F.col("short") & F.expr(_LONG_ENOUGH) | ~F.col("short") & (F.size("b") < 2)).select("pair_id", S.strip(F.col("ing")).alias("ing"), S.strip(F.col("rus")).alias("rus"), F.when(F.col("short"), "whole").otherwise("prose").alias("kind"))
    aligned = AL.align_texts(own.where(~F.col("short") & (F.size("b") >= 2)), "pair_id", "a", "b", threshold=0.35, policy="fifth")
    return whole.unionByName(aligned.select("pair_id", "ing", "rus", F.lit("sentence").alias("kind")))


def titled(c):
    """(title, body): the first line that isn't blank, if it is a heading of at most eight words in capitals."""
    first = S.strip(F.regexp_extract(c, "^\\s*(\\S[^\\n]*)", 1))
    heading = (F.size(F.split(first, "\\s+")) <= 8) & (F.upper(first) == first) & first.rlike("\\p{L}")
    return F.when(heading, first), F.when(heading, S.strip(F.regexp_replace(c, "^\\s*\\S[^\\n]*", ""))).otherwise(c)


@C.add("C16_resplit")
def c16(spark, d):
    """Title pair and aligned body, or the whole body where nothing aligns."""
    t = table(spark, d, PAR).where("pair_type = 'bilingual_para' and ing is not null and rus is not null")
    (ing_title, ing), (rus_title, rus) = titled(F.col("ing")), titled(F.col("rus"))
    t = t.select("pair_id", ing_title.alias("ing_title"), rus_title.alias("rus_title"), ing.alias("ing"), rus.alias("rus"))
    titles = t.where("ing_title is not null and rus_title is not null").select("pair_id", F.col("ing_title").alias("ing"), F.col("rus_title").alias("rus"))
    aligned = AL.align_lengths(t.select("pair_id", W.sentences_kept(F.col("ing")).alias("a"), W.sentences_kept(F.col("rus")).alias("b")), "pair_id", "a", "b")
    rest = t.join(aligned.select("pair_id").distinct(), "pair_id", "left_anti").where("length(ing) > 20 and length(rus) > 20").select("pair_id", "ing", "rus")
    return titles.unionByName(aligned).unionByName(rest)


@C.add("C17_catalog_build", "select slug, priority, category_slug, title from (select *, row_number() over (partition by slug order by priority, title, download_count) n from book_catalog) where n = 1 and slug not in (select slug from download_state where starts_with(status, 'ok') and slug is not null)")
def c17(spark, d):
    best = R.first_per_key(table(spark, d, "book_catalog"), ["slug"], F.col("priority").asc_nulls_last(), F.col("title").asc_nulls_last(), F.col("download_count").asc_nulls_last())
    done = table(spark, d, "download_state").where(F.col("status").startswith("ok")).select("slug").distinct()
    return B.not_done(best, done, "slug").select("slug", "priority", "category_slug", "title").orderBy("priority", "category_slug", "slug")


@C.add("C18_timeline", "select case when y < 1995 then 'early' when y < 1999 then 'middle' else 'late' end as era, count(*) as n, min(o_orderkey) as first_key from (select o_orderkey, coalesce(year(o_orderdate), 0) y from orders where o_orderpriority in ('1-URGENT', '2-HIGH')) group by era")
def c18(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    era = R.era_of(Q.YEAR(), (("early", 0, 1995), ("middle", 1995, 1999), ("late", 1999, 9999)), closed=False)
    return o.groupBy(era.alias("era")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


_MONTHS = ((0, 1, 3), (1, 4, 6), (2, 7, 12), (5, 0, 99))


@C.add("C18_map_view", f"select e.event_id, x.i as era from events e join (values {', '.join(map(str, _MONTHS))}) x(i, a, b) on month(e.ts) between x.a and x.b where e.value is not null and e.event_type in ('view', 'click')")
def c18_map(spark, d):
    """Points with a place and a chosen category, under each of the eras that hold them."""
    v = F.col("value")
    e = table(spark, d, "events").where(O.on_map(v, v, F.col("event_type"), ["view", "click"], F.month("ts"), 0, 99))
    return R.in_eras(e.select("event_id", "ts"), F.month("ts"), _MONTHS).select("event_id", "era")


@C.add("C18_encyclopedia_view", """
with s as (select distinct slug from book_catalog where coalesce(contains(lower(title), 'сад'), false) or coalesce(contains(lower(author), 'сад'), false)),
r as (select slug, mono_id, row_number() over (partition by slug order by mono_id) k, count(*) over (partition by slug) n from s join mono m on m.source = s.slug)
select s.slug, coalesce(string_agg(mono_id, '|' order by mono_id) filter (where k <= 3), '') as shown, greatest(coalesce(max(n), 0) - 3, 0) as more from s left join r using (slug) group by s.slug""")
def c18_encyclopedia(spark, d):
    """Articles found by a word in any of their names, with their first three related records and the number of the others."""
    found = table(spark, d, "book_catalog").where(O.any_contains([F.col("title"), F.col("author")], "Сад")).select("slug").distinct()
    related = table(spark, d, "mono").select(F.col("source").alias("slug"), "mono_id")
    n = related.groupBy("slug").agg(F.count("*").alias("n"))
    first = R.top_per_key(related.join(found, "slug", "left_semi"), ["slug"], 3, "mono_id").groupBy("slug").agg(F.array_join(F.array_sort(F.collect_list("mono_id")), "|").alias("shown"))
    out = found.join(first, "slug", "left").join(n, "slug", "left")
    return out.select("slug", F.coalesce("shown", F.lit("")).alias("shown"), F.greatest(F.coalesce("n", F.lit(0)) - 3, F.lit(0)).cast("bigint").alias("more"))


_TOKEN = "([\\p{L}\\p{M}\\p{N}]+(?:-[\\p{L}\\p{M}\\p{N}]+)*|[^\\s\\p{Z}])"


def bleu_tokens(c):
    """Words and signs, small letters."""
    return F.regexp_extract_all(F.lower(c), F.lit(_TOKEN), 1)


def clipped(pairs, hyp: str, ref: str, most: int = 4):
    """(n, hit, total, h_len, r_len): clipped matches of the n-grams of two word arrays, all n-grams, and all words; the counts of a row stay in its task."""

    def run(batches):
        out = {n: [0, 0, 0, 0] for n in range(1, most + 1)}
        for b in batches:
            for h, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, r = h or [], r or []
                for n, sums in out.items():
                    hyps, refs = (Counter(zip(*(x[i:] for i in range(n)))) for x in (h, r))
                    sums[0] += (hyps & refs).total()
                    sums[1] += hyps.total()
                    sums[2] += len(h)
                    sums[3] += len(r)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), *(pa.array(x, pa.int64()) for x in zip(*out.values()))], names=["n", "hit", "total", "h_len", "r_len"])

    return pairs.select(hyp, ref).mapInArrow(run, "n int, hit bigint, total bigint, h_len bigint, r_len bigint").groupBy("n").agg(*(F.sum(c).alias(c) for c in ("hit", "total", "h_len", "r_len")))


@C.add("A18_corpus_bleu")
def a18(spark, d):
    """BLEU of the translations with each word's dictionary meaning against the given ones, over every pair with both sides.

    (n, precision, brevity_penalty, bleu) for n from 1 to 4, the last two the same in each row.
    As in sacreBLEU an order without a match counts as half, then a quarter, ... of one, and
    the score is 0 if there are no matches or no n-grams of an order at all.
    """
    t = table(spark, d, PAR).where("ing is not null and rus is not null").select("pair_id", "ing", "rus")
    words = t.select("pair_id", F.posexplode(bleu_tokens(S.normalize_palochka(F.col("ing")))).alias("i", "word"))
    words = words.join(Q.translations(spark, d), "word", "left").select("pair_id", "i", F.coalesce("translation", "word").alias("t"))
    # the reference comes as the entry before the first word, so it moves once
    whole = words.unionByName(t.select("pair_id", F.lit(-1).alias("i"), F.col("rus").alias("t"))).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("w"))
    hyp = F.array_join(F.transform(F.filter("w", lambda x: x["i"] >= 0), lambda x: x["t"]), " ")
    sums = clipped(whole.select(bleu_tokens(hyp).alias("hyp"), bleu_tokens(F.col("w")[0]["t"]).alias("ref")), "hyp", "ref")
    every = sums.agg(F.sort_array(F.collect_list(F.struct("n", "hit", "total"))).alias("a"), F.max("h_len").alias("h"), F.max("r_len").alias("r"))
    none = lambda x: F.size(F.filter("a", lambda y: (y["hit"] == 0) & (y["n"] <= x["n"])))
    smooth = F.transform("a", lambda x: F.when(x["hit"] > 0, x["hit"] / x["total"]).otherwise(F.try_divide(F.pow(F.lit(0.5), none(x)), x["total"])))
    penalty = F.when(F.col("h") >= F.col("r"), 1.0).when(F.col("h") > 0, F.exp(1 - F.col("r") / F.col("h"))).otherwise(0.0)
    score = F.when(F.forall("a", lambda x: x["total"] > 0) & F.exists("a", lambda x: x["hit"] > 0), penalty * F.exp(F.aggregate(smooth, F.lit(0.0), lambda s, x: s + F.log(x)) / F.size("a"))).otherwise(0.0)
    every = every.select("a", penalty.alias("p"), score.alias("s"))
    return every.select(F.explode("a").alias("x"), "p", "s").select("x.n", F.round(F.try_divide(F.col("x.hit"), F.col("x.total")), 6).alias("precision"), F.round("p", 6).alias("brevity_penalty"), F.round("s", 6).alias("bleu"))


# ---- streams


@C.add("R01_token_bucket")
def r01(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))
    return B.allow(e, "user_id", "t", "event_id", capacity=3.0, rate=0.0005)


@C.add("R01_token_bucket_default")
def r01_default(spark, d):
    """With the documented capacity and rate."""
    e = table(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))
    return B.allow(e, "user_id", "t", "event_id")


@C.add("R02_resume", "select slug from (select distinct slug from book_catalog) where slug not in (select slug from download_state where status = 'ok' and slug is not null)")
def r02(spark, d):
    return B.not_done(table(spark, d, "book_catalog").select("slug").distinct(), table(spark, d, "download_state").where("status = 'ok'"), "slug")


@C.add("R03_debounce", "select event_id from (select event_id, epoch_us(ts) / 1e6 t, lead(epoch_us(ts) / 1e6) over (partition by user_id order by ts, event_id) n from events) where n is null or n - t > 3600")
def r03(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))
    return B.debounce(e, "user_id", "t", "event_id", 3600.0).select("event_id")


@C.add("R05_windows", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def r05(spark, d):
    return B.windowed(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts").withColumn("total", F.round("total", 4))


@C.add("R06_sessions", """
with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end s from events), g as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) g from e)
select user_id, min(ts) as start, count(*) as n from g group by user_id, g""")
def r06(spark, d):
    return B.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts")


QUERIES, SQL = C.queries, C.sql
