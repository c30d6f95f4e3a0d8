"""Queries over filters (P), joins (J), aggregations (A), windows (W), sorts (T) and set operations (U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions import profile as P
from lexloom.functions import strings as S
from lexloom.functions import words as W
from lexloom.operators import filters as O
from lexloom.operators import relations as R
from lexloom.operators import spelling as SP

from .base import Catalogue, lit, s_replace, s_strip, s_sub, table
from .function_queries import C_MODEL_WORDS, CLASS_SQL, SCORE_SQL

C = Catalogue()
def YEAR():  # noqa: N802
    """Columns need a session, so the expression is made when it is used."""
    return F.year("o_orderdate")

PAR, BOOK = "parallel_ing_rus", "book_catalog"
_MWI = C_MODEL_WORDS.format("ing")


# ---- filters and projections


@C.add("P01_year_between", "select o_orderkey from orders where year(o_orderdate) between 1995 and 1997")
def p01(spark, d):
    return O.period_and_category(table(spark, d, "orders"), YEAR(), F.col("o_orderpriority"), 1995, 1997).select("o_orderkey")


@C.add("P02_category", "select slug, title from book_catalog where category_slug = 'istoriya'")
def p02(spark, d):
    return table(spark, d, BOOK).where(F.col("category_slug") == "istoriya").select("slug", "title")


@C.add("P03_year_and_category", "select o_orderkey from orders where year(o_orderdate) between 1995 and 1997 and o_orderpriority = '2-HIGH'")
def p03(spark, d):
    return O.period_and_category(table(spark, d, "orders"), YEAR(), F.col("o_orderpriority"), 1995, 1997, "2-HIGH").select("o_orderkey")


@C.add("P04_single_bound_ignored", "select count(*) as n, (select count(*) from orders where o_orderpriority = '5-LOW') as n_low from orders")
def p04(spark, d):
    o = table(spark, d, "orders")
    one = O.period_and_category(o, YEAR(), F.col("o_orderpriority"), first=1996).agg(F.count("*").alias("n"))
    low = O.period_and_category(o, YEAR(), F.col("o_orderpriority"), last=1996, wanted="5-LOW").agg(F.count("*").alias("n_low"))
    return one.crossJoin(low)  # one row each


@C.add("P05_role_equals", "select mono_id from mono where lang = 'rus'")
def p05(spark, d):
    return table(spark, d, "mono").where(F.col("lang") == "rus").select("mono_id")


@C.add("P06_name_contains", "select distinct slug, title from book_catalog where contains(lower(title), 'дорога')")
def p06(spark, d):
    return table(spark, d, BOOK).where(O.name_contains(F.col("title"), "ДОРОГА")).select("slug", "title").distinct()


_DICT = f"(select distinct unnest({_MWI}) as word from parallel_ing_rus)"


def dictionary(spark, d):
    """Words of the first side, each once."""
    return table(spark, d, PAR).select(F.explode(W.model_words(F.col("ing"))).alias("word")).distinct()


def translations(spark, d):
    """First meaning of each word, palochkas and capitals in one spelling."""
    t = table(spark, d, "translations").where("word is not null and translation is not null")
    t = t.select(F.lower(S.normalize_palochka(S.strip(F.col("word")))).alias("word"), S.strip(F.col("translation")).alias("translation")).where("word <> '' and translation <> ''")
    return t.groupBy("word").agg(F.min("translation").alias("translation"))


_K = P.CONSONANTS
_tw = s_sub(f"replace({s_strip('word')}, 'Ӏ', 'ӏ')", f"([{_K}])I", "\\1ӏ")
_tw = s_sub(s_sub(_tw, f"([{_K}])1([а-яёӏ])", "\\1ӏ\\2"), f"([{_K}])1([а-яёӏ])", "\\1ӏ\\2")
TR_SQL = f"(select word, min(translation) as translation from (select lower({_tw}) as word, {s_strip('translation')} as translation from translations where word is not null and translation is not null) where word <> '' and translation <> '' group by word)"


@C.add("P07_prefix_with_translation", f"select d.word from {_DICT} d where starts_with(d.word, 'ха') and d.word in (select word from {TR_SQL})")
def p07(spark, d):
    return dictionary(spark, d).where(F.col("word").startswith("ха")).join(translations(spark, d).select("word"), "word", "left_semi")


@C.add("P08_any_contains", "select distinct slug from book_catalog where coalesce(contains(lower(title), 'сад'), false) or coalesce(contains(lower(author), 'сад'), false) or coalesce(contains(lower(category_name), 'сад'), false)")
def p08(spark, d):
    return table(spark, d, BOOK).where(O.any_contains([F.col("title"), F.col("author"), F.col("category_name")], "Сад")).select("slug").distinct()


@C.add("P09_map_filter", "select event_id from events where value is not null and event_type in ('view', 'click') and month(ts) between 1 and 3")
def p09(spark, d):
    v = F.col("value")
    return table(spark, d, "events").where(O.on_map(v, v, F.col("event_type"), ["view", "click"], F.month("ts"), 1, 3)).select("event_id")


@C.add("P10_layer_visible", "select s_suppkey, e as era from supplier, range(0, 6) t(e) where list_contains([s_nationkey % 5, s_nationkey % 3], e) or e = 5")
def p10_layer(spark, d):
    s = table(spark, d, "supplier").withColumn("eras", F.array((F.col("s_nationkey") % 5), (F.col("s_nationkey") % 3)))
    out = None
    for era in range(6):
        part = s.where(O.layer_visible(F.col("eras"), era)).select("s_suppkey", F.lit(era).cast("bigint").alias("era"))
        out = part if out is None else out.unionByName(part)
    return out


@C.add("P11_language_filter", f"select mono_id from mono where text is not null and {CLASS_SQL} in ('ing', 'mixed') and {SCORE_SQL} >= 0.05")
def p11(spark, d):
    c = F.col("text")
    return table(spark, d, "mono").where(W.classify(c).isin("ing", "mixed") & (W.language_score(c) >= P.MIN_SCORE)).select("mono_id")


@C.add("P12_min_length", "select pair_id from parallel_ing_rus where length(ing) >= 15 and length(rus) > 12")
def p12(spark, d):
    return table(spark, d, PAR).where("length(ing) >= 15 and length(rus) > 12").select("pair_id")


@C.add("P13_length_ratio", "select pair_id from parallel_ing_rus where length(ing) / cast(greatest(length(rus), 1) as double) > 0.8 and length(ing) / cast(greatest(length(rus), 1) as double) < 1.1")
def p13(spark, d):
    return table(spark, d, PAR).where(O.ratio_between(F.col("ing"), F.col("rus"), 0.8, 1.1)).select("pair_id")


@C.add("P13_length_ratio_default", "select pair_id from parallel_ing_rus where length(ing) / cast(greatest(length(rus), 1) as double) > 0.4 and length(ing) / cast(greatest(length(rus), 1) as double) < 2.5")
def p13_default(spark, d):
    """With the documented bounds."""
    return table(spark, d, PAR).where(O.ratio_between(F.col("ing"), F.col("rus"), 0.4, 2.5)).select("pair_id")


@C.add("P14_symmetric_ratio_default", "select pair_id from parallel_ing_rus where ing is not null and rus is not null and greatest(length(ing), length(rus)) / cast(greatest(least(length(ing), length(rus)), 1) as double) <= 5")
def p14_default(spark, d):
    """With the documented bound."""
    return table(spark, d, PAR).where("ing is not null and rus is not null").where(O.ratio_at_most(F.col("ing"), F.col("rus"), 5)).select("pair_id")


@C.add("P14_symmetric_ratio", "select pair_id from parallel_ing_rus where ing is not null and rus is not null and greatest(length(ing), length(rus)) / cast(greatest(least(length(ing), length(rus)), 1) as double) <= 1.2")
def p14(spark, d):
    return table(spark, d, PAR).where("ing is not null and rus is not null").where(O.ratio_at_most(F.col("ing"), F.col("rus"), 1.2)).select("pair_id")


@C.add("P15_header_drop", "select pair_id from parallel_ing_rus where not regexp_matches(coalesce(rus, ''), '(?i)<[hi][1-6]?')")
def p15(spark, d):
    return table(spark, d, PAR).where(~F.coalesce("rus", F.lit("")).rlike("(?i)<[hi][1-6]?")).select("pair_id")


@C.add("P16_valid_words", f"select word from {_DICT} where regexp_matches(word, '^[а-яёӀӏ\\-]+$') and not starts_with(word, '-') and length(word) >= 2")
def p16(spark, d):
    return dictionary(spark, d).where(F.col("word").rlike("^[а-яёӀӏ\\-]+$") & ~F.col("word").startswith("-") & (F.length("word") >= 2))


@C.add("P17_marked_words", f"select word, regexp_matches(word, '(?i){P.TOKEN_MARKERS}') as narrow from {_DICT} where regexp_matches(word, '(?i){P.TOKEN_MARKERS_WIDE}')")
def p17(spark, d):
    return dictionary(spark, d).where(F.col("word").rlike(f"(?iu){P.TOKEN_MARKERS_WIDE}")).select("word", F.col("word").rlike(f"(?iu){P.TOKEN_MARKERS}").alias("narrow"))


@C.add("P18_stop_words", f"select word from {_DICT} where word not in (select word from common_words where word is not null and lang = 'ing')")
def p18(spark, d):
    return dictionary(spark, d).join(table(spark, d, "common_words").where("lang = 'ing'").select("word"), "word", "left_anti")


@C.add("P19_catalog_filters", "select distinct slug, priority from book_catalog where priority <= 2 and category_slug in ('folklor', 'gazety') order by priority, slug limit 20")
def p19(spark, d):
    return table(spark, d, BOOK).where("priority <= 2 and category_slug in ('folklor', 'gazety')").select("slug", "priority").distinct().orderBy("priority", "slug").limit(20)


@C.add("P20_status_prefix", "select entry_id from download_state where starts_with(status, 'ok')")
def p20(spark, d):
    return table(spark, d, "download_state").where(F.col("status").startswith("ok")).select("entry_id")


@C.add("P21_request_code", """
select doc_id, case when coalesce(trim(text), '') = '' then 'empty' when length(text) > 600 then 'too_long'
 when not coalesce(s in ('inh', 'ru'), false) or not coalesce(t in ('inh', 'ru'), false) then 'bad_lang' when s = t then 'same_lang' else 'ok' end as code
from (select doc_id, text, case lang when 'ing' then 'inh' when 'rus' then 'ru' else lang end s, case when doc_id % 3 = 0 then 'inh' else 'ru' end t from documents)""")
def p21(spark, d):
    src = F.when(F.col("lang") == "ing", "inh").when(F.col("lang") == "rus", "ru").otherwise(F.col("lang"))
    tgt = F.when(F.col("doc_id") % 3 == 0, "inh").otherwise("ru")
    return table(spark, d, "documents").select("doc_id", O.request_code(F.col("text"), src, tgt, P.TRANSLATE_LANGS, 600).alias("code"))


@C.add("P22_status_bucket", "select doc_id, case when coalesce(length(text), 0) < 200 then 'scan_skip' else 'ok_text' end as status from documents")
def p22(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.coalesce(F.length("text"), F.lit(0)) < 200, "scan_skip").otherwise("ok_text").alias("status"))


_SKIP = "^\\s*(?:глава|часть|дакъа|стр|с|рис)[.\\s]|^\\s*\\d+\\s*$"


@C.add("P23_skip_lines", f"select doc_id, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) l from documents) where not regexp_matches(l, {lit('(?i)' + _SKIP)}) group by doc_id")
def p23(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.where(~F.col("l").rlike(f"(?iu){_SKIP}")).groupBy("doc_id").agg(F.count("*").alias("n"))


def triage(pairs, known):
    """(word, translation, verdict, reason): the first rule that holds decides."""
    t = F.col("translation")
    base = F.nullif(F.regexp_extract(F.lower(t), P.DERIVED, 1), F.lit(""))
    p = pairs.withColumn("base", base).join(known.select(F.col("word").alias("base"), F.col("translation").alias("base_translation")), "base", "left")
    verdict = (
        F.when(F.lower("word") == F.lower(t), "bad:same")
        .when(F.col("base").isNotNull(), F.when(F.col("base_translation").isNotNull(), "good:derived").otherwise("bad:derived"))
        .when(t.rlike(f"(?iu){P.BARE}"), "bad:note")
        .when(F.length(S.strip(t)) < 3, "bad:short")
        .when(t.rlike("\\d"), "bad:digit")
        .when(F.size(F.split(S.squeeze(t), " ")) > 5, "suspect:long")
        .when(F.col("word").rlike("[a-zA-Z]"), "bad:latin")
        .otherwise("good:plain")
    )
    out = p.withColumn("v", verdict)
    return out.select("word", F.when(F.col("v") == "good:derived", F.col("base_translation")).otherwise(t).alias("translation"), F.split("v", ":")[0].alias("verdict"), F.split("v", ":")[1].alias("reason"))


_TRI_IN = f"(select word, case when ascii(word) % 7 = 0 then concat('понуд. ф. от ', (select min(word) from {TR_SQL})) when ascii(word) % 7 = 1 then 'прич. наст.' when ascii(word) % 7 = 2 then concat(translation, ' 12') else translation end as translation from {TR_SQL})"
TRIAGE_SQL = f"""
with p as (select word, translation, nullif(regexp_extract(lower(translation), {lit(P.DERIVED)}, 1), '') as base from {_TRI_IN}),
j as (select p.*, k.translation as bt from p left join {TR_SQL} k on p.base = k.word),
v as (select *, case when lower(word) = lower(translation) then 'bad:same' when base is not null then (case when bt is not null then 'good:derived' else 'bad:derived' end)
 when regexp_matches(translation, {lit('(?i)' + P.BARE)}) then 'bad:note' when length({s_strip('translation')}) < 3 then 'bad:short' when regexp_matches(translation, '\\d') then 'bad:digit'
 when len(string_split({s_strip(s_sub('translation', f'[{P.WS}\\n]+', ' '))}, ' ')) > 5 then 'suspect:long' when regexp_matches(word, '[a-zA-Z]') then 'bad:latin' else 'good:plain' end v from j)
select word, case when v = 'good:derived' then bt else translation end as translation, string_split(v, ':')[1] as verdict, string_split(v, ':')[2] as reason from v"""


def triage_input(spark, d):
    t = translations(spark, d)
    first = t.agg(F.min("word").alias("w0"))
    k = F.ascii("word") % 7
    made = F.when(k == 0, F.concat(F.lit("понуд. ф. от "), "w0")).when(k == 1, "прич. наст.").when(k == 2, F.concat("translation", F.lit(" 12"))).otherwise(F.col("translation"))
    return t.crossJoin(F.broadcast(first)).select("word", made.alias("translation"))  # one row


C.add("P24_translation_triage", TRIAGE_SQL)(lambda spark, d: triage(triage_input(spark, d), translations(spark, d)))


@C.add("P25_both_directions", "select pair_id, ing as src, rus as tgt, 'ing' as src_lang, 'rus' as tgt_lang from parallel_ing_rus union all select pair_id, rus, ing, 'rus', 'ing' from parallel_ing_rus")
def p25(spark, d):
    return O.both_directions(table(spark, d, PAR), ["pair_id"], "ing", "rus", "ing", "rus")


# ---- joins


@C.add("J01_lookup_default", f"select w.word, coalesce(t.translation, '') as translation from {_DICT} w left join {TR_SQL} t using (word)")
def j01(spark, d):
    return R.lookup(dictionary(spark, d), translations(spark, d), "word", "translation", "")


@C.add("J02_sections_with_gaps", """
with a as (select num, min(pair_id) a from parallel_ing_rus where pair_type = 'verse' and pair_id % 2 = 0 and num is not null group by num), b as (select num, min(pair_id) b from parallel_ing_rus where pair_type = 'verse' and pair_id % 3 = 0 and num is not null group by num)
select coalesce(a.num, b.num) as num, case when b is null then 'left' when a is null then 'right' else 'both' end as side from a full join b on a.num = b.num""")
def j02(spark, d):
    v = table(spark, d, PAR).where("pair_type = 'verse' and num is not null")
    a = v.where("pair_id % 2 = 0").groupBy("num").agg(F.min("pair_id").alias("a"))
    b = v.where("pair_id % 3 = 0").groupBy("num").agg(F.min("pair_id").alias("b"))
    return a.join(b, "num", "full_outer").select("num", F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").otherwise("both").alias("side"))


_GRID = "(select c.chapter, v.verse from (select unnest(range(1, 25)) as chapter, unnest([" + ", ".join(map(str, P.VERSES_PER_CHAPTER)) + "]) as n) c, lateral (select unnest(range(1, c.n + 1)) as verse) v)"
_VERSE = "(select try_cast(string_split(verse_ref, ':')[1] as bigint) as chapter, try_cast(string_split(verse_ref, ':')[2] as bigint) as verse, min({0}) as {0} from parallel_ing_rus where pair_type = 'verse' and verse_ref is not null and length({0}) > 5 group by 1, 2)"


def grid(spark):
    """Expected (chapter, verse) of the verse table."""
    n = F.array(*[F.lit(x) for x in P.VERSES_PER_CHAPTER])
    return spark.range(1).select(F.posexplode(n).alias("c", "n")).select((F.col("c") + 1).cast("bigint").alias("chapter"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n").cast("bigint"))).alias("verse"))


def verse_side(spark, d, col):
    ref = F.split("verse_ref", ":")
    v = table(spark, d, PAR).where(f"pair_type = 'verse' and verse_ref is not null and length({col}) > 5")
    return v.groupBy(F.get(ref, F.lit(0)).try_cast("bigint").alias("chapter"), F.get(ref, F.lit(1)).try_cast("bigint").alias("verse")).agg(F.min(col).alias(col))


@C.add("J03_expected_grid", f"select g.chapter, g.verse, ing, rus from {_GRID} g left join {_VERSE.format('ing')} a on g.chapter = a.chapter and g.verse = a.verse left join {_VERSE.format('rus')} b on g.chapter = b.chapter and g.verse = b.verse")
def j03(spark, d):
    return grid(spark).join(verse_side(spark, d, "ing"), ["chapter", "verse"], "left").join(verse_side(spark, d, "rus"), ["chapter", "verse"], "left")


@C.add("J04_by_string_key", """
with a as (select poem_id, min(ing) ing from parallel_ing_rus where poem_id is not null group by 1), b as (select poem_id, min(rus) rus from parallel_ing_rus where poem_id is not null and pair_id % 4 <> 0 group by 1)
select poem_id, case when length(ing) > 50 and length(rus) > 50 then 'pair' else 'skip' end as verdict from a full join b using (poem_id)""")
def j04(spark, d):
    t = table(spark, d, PAR).where("poem_id is not null")
    a, b = t.groupBy("poem_id").agg(F.min("ing").alias("ing")), t.where("pair_id % 4 <> 0").groupBy("poem_id").agg(F.min("rus").alias("rus"))
    return a.join(b, "poem_id", "full_outer").select("poem_id", F.when((F.length("ing") > 50) & (F.length("rus") > 50), "pair").otherwise("skip").alias("verdict"))


_TOK = f"(select mono_id, unnest({C_MODEL_WORDS.format('text')}) as word from mono)"


def tokens(spark, d):
    return table(spark, d, "mono").select("mono_id", F.explode(W.model_words(F.col("text"))).alias("word"))


@C.add("J05_known_tokens", f"select mono_id, word from {_TOK} where word in (select word from {_DICT})")
def j05(spark, d):
    return tokens(spark, d).join(dictionary(spark, d), "word", "left_semi").select("mono_id", "word")


@C.add("J06_unknown_tokens", f"select mono_id, word from {_TOK} where word not in (select word from {_DICT})")
def j06(spark, d):
    return tokens(spark, d).join(dictionary(spark, d), "word", "left_anti").select("mono_id", "word")


@C.add("J07_derived_base", f"""
with p as (select word, nullif(regexp_extract(lower(translation), {lit(P.DERIVED)}, 1), '') base from {_TRI_IN})
select p.word, p.base, k.translation as base_translation from p left join {TR_SQL} k on p.base = k.word where p.base is not null""")
def j07(spark, d):
    p = triage_input(spark, d).withColumn("base", F.nullif(F.regexp_extract(F.lower("translation"), P.DERIVED, 1), F.lit(""))).where("base is not null")
    return p.select("word", "base").join(translations(spark, d).select(F.col("word").alias("base"), F.col("translation").alias("base_translation")), "base", "left")


_CAT = "(select slug, min(category_slug) as category_slug, min(priority) as priority from book_catalog group by slug)"


@C.add("J08_catalog_default", f"select mono_id, coalesce(category_slug, 'unknown') as category_slug, coalesce(priority, 9) as priority from mono m left join {_CAT} c on m.source = c.slug")
def j08(spark, d):
    cat = table(spark, d, BOOK).groupBy("slug").agg(F.min("category_slug").alias("category_slug"), F.min("priority").alias("priority"))
    m = table(spark, d, "mono").select("mono_id", "source").join(cat, F.col("source") == F.col("slug"), "left")
    return m.select("mono_id", F.coalesce("category_slug", F.lit("unknown")).alias("category_slug"), F.coalesce("priority", F.lit(9)).alias("priority"))


@C.add("J09_as_of", """
with a as (select event_id, user_id, epoch_us(ts) / 1000000.0 t from events where event_type = 'purchase'), b as (select user_id, epoch_us(ts) / 1000000.0 t from events where event_type = 'view')
select event_id, round(max(b.t), 3) as t_view from a left join b on a.user_id = b.user_id and b.t <= a.t + 5 group by event_id""")
def j09(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)).alias("t"))
    views = e.where("event_type = 'view'").select("user_id", F.col("t").alias("tv"), F.col("t").alias("seen"))
    return R.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "t"), views, ["user_id"], "t", "tv", ["seen"], tolerance=5.0).select("event_id", F.round("seen", 3).alias("t_view"))


@C.add("J10_as_of_strict", """
with a as (select event_id, user_id, epoch_us(ts) t from events where event_type = 'purchase'), b as (select user_id, epoch_us(ts) t from events where event_type = 'click')
select event_id, max(b.t) as t_click from a left join b on a.user_id = b.user_id and b.t < a.t group by event_id""")
def j10(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    clicks = e.where("event_type = 'click'").select("user_id", F.col("t").alias("tc"), F.col("t").alias("seen"))
    return R.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "t"), clicks, ["user_id"], "t", "tc", ["seen"], strict=True).select("event_id", F.col("seen").alias("t_click"))


@C.add("J11_positional_zip", """
with a as (select user_id, event_id a, row_number() over (partition by user_id order by event_id) n from events where event_type = 'view'), b as (select user_id, event_id b, row_number() over (partition by user_id order by event_id) n from events where event_type = 'click')
select user_id, n, a, b from a join b using (user_id, n)""")
def j11(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("a"))
    b = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("b"))
    return R.zip_by_position(a, b, ["user_id"], "a", "b").select("user_id", "n", "a", "b")


_CW = "(select distinct word from common_words where word is not null and length(word) > 2 and lang <> 'eng')"


#: DuckDB measures bytes; one byte for each letter makes that the distance in letters.
def _one_byte(e: str) -> str:
    return f"translate({e}, 'абвгдежзийклмнопрстуфхцчшщъыьэюяёӏ', '0123456789!#$%&()*+,-./:;<=>?@[]^_')"


LEV = f"levenshtein({_one_byte('c.word')}, {_one_byte('t.word')})"


@C.add("J12_edit_distance", f"select c.word, t.word as candidate, {LEV} as distance from {_CW} c, {TR_SQL} t where {LEV} <= 2")
def j12(spark, d):
    common = table(spark, d, "common_words").where("length(word) > 2 and lang <> 'eng'").select("word").distinct()
    return SP.near(common, translations(spark, d).select("word"))


@C.add("J13_keywords_in_titles", """
with k as (select distinct n_name, lower(n_name) kw from nation), b as (select distinct slug, lower(concat(title, ' ', coalesce(author, ''))) t from book_catalog where title is not null),
w as (select distinct unnest(string_split(lower(title), ' ')) kw from book_catalog where title is not null and priority = 1)
select distinct w.kw, b.slug from w, b where length(w.kw) > 3 and contains(b.t, w.kw)""")
def j13(spark, d):
    """Substring search of many keywords: texts are cut into their substrings of the keywords' lengths, so the join is an equi-join."""
    b = table(spark, d, BOOK).where("title is not null")
    kw = b.where("priority = 1").select(F.explode(F.split(F.lower("title"), " ")).alias("kw")).where("length(kw) > 3").distinct()
    lengths = F.broadcast(kw.agg(F.collect_set(F.length("kw")).alias("lengths")))  # one row, as many numbers as word lengths
    text = b.select("slug", F.lower(F.concat("title", F.lit(" "), F.coalesce("author", F.lit("")))).alias("t")).distinct()
    grams = F.flatten(F.transform("lengths", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - n + 1, F.lit(1))), lambda i: F.substring(F.col("t"), i, n))))
    return text.crossJoin(lengths).select("slug", F.explode(F.array_distinct(grams)).alias("kw")).join(kw, "kw").select("kw", "slug").distinct()


@C.add("J14_timeline_era", "select o_orderkey, case when y < 1995 then 'early' when y < 1999 then 'middle' when y < 9999 then 'late' end as era from (select o_orderkey, coalesce(year(o_orderdate), 0) y from orders)")
def j14(spark, d):
    eras = (("early", 0, 1995), ("middle", 1995, 1999), ("late", 1999, 9999))
    return table(spark, d, "orders").select("o_orderkey", R.era_of(YEAR(), eras, closed=False).alias("era"))


_MAP = ((0, 0, 1994), (1, 1995, 1996), (2, 1997, 1999), (5, 0, 9999))


@C.add("J14_map_eras", f"select o_orderkey, e.i as era from (select o_orderkey, coalesce(year(o_orderdate), 0) y from orders) o join (values {', '.join(str(x) for x in _MAP)}) e(i, a, b) on o.y between e.a and e.b")
def j14b(spark, d):
    return R.in_eras(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), YEAR(), _MAP).select("o_orderkey", "era")


@C.add("J15_related_words", f"""
with w as (select word, substring(word, 1, 4) p from {TR_SQL}), j as (select a.word, b.word as related, row_number() over (partition by a.word order by length(b.word), b.word) rk from w a join w b on a.p = b.p and a.word <> b.word)
select word, related, rk as rank from j where rk <= 6""")
def j15(spark, d):
    return SP.related_words(translations(spark, d).select("word"), translations(spark, d).select("word"), 6)


@C.add("J16_link_table", "select a.pair_id as pair_a, b.pair_id as pair_b from parallel_ing_rus a join parallel_ing_rus b on a.verse_ref = b.verse_ref where a.ing is not null and b.rus is not null and a.pair_id <> b.pair_id")
def j16(spark, d):
    """Texts of one language with those of the other that a reference links to them, without a row with itself."""
    t = table(spark, d, PAR).where("verse_ref is not null")
    a = t.where("ing is not null").select("verse_ref", F.col("pair_id").alias("pair_a"))
    return a.join(t.where("rus is not null").select("verse_ref", F.col("pair_id").alias("pair_b")), "verse_ref").where("pair_a <> pair_b").select("pair_a", "pair_b")


@C.add("J17_url_rewrite", "select distinct a.slug, b.download_page_url as other from book_catalog a join book_catalog b on regexp_replace(a.download_page_url, '/item/', '/') = regexp_replace(b.download_page_url, '/item/', '/')")
def j17(spark, d):
    def bare(c):
        return F.when(F.instr(c, "/item/") > 0, F.concat(F.substring_index(c, "/item/", 1), F.lit("/"), F.substring(c, F.instr(c, "/item/") + 6, F.length(c)))).otherwise(c)

    b = table(spark, d, BOOK)
    a = b.select("slug", bare(F.col("download_page_url")).alias("k")).distinct()
    return a.join(b.select(F.col("download_page_url").alias("other"), bare(F.col("download_page_url")).alias("k")).distinct(), "k").select("slug", "other").distinct()


_BI = f"(select doc, w1, w2 from (select pair_id doc, word w1, lead(word) over (partition by pair_id order by i) w2 from (select pair_id, unnest({_MWI}) word, generate_subscripts({_MWI}, 1) i from parallel_ing_rus)) where w2 is not null)"


def bigrams(df, key, col):
    """(key, w1, w2): neighbours within a text; no window is needed, as the words come as an array."""
    d = df.select(key, W.model_words(F.col(col)).alias("__w")).where(F.size("__w") > 1)
    n = F.size("__w") - 1
    return d.select(key, F.explode(F.arrays_zip(F.slice("__w", F.lit(1), n).alias("w1"), F.slice("__w", F.lit(2), n).alias("w2"))).alias("b")).select(key, "b.w1", "b.w2")


@C.add("J18_unseen_bigrams", f"""
with seen as (select w1, w2 from {_BI} group by w1, w2 having count(*) >= 2), b as (select distinct w1, w2 from {_BI})
select b.w1, b.w2 from b where not exists (select 1 from seen s where s.w1 = b.w1 and s.w2 = b.w2)""")
def j18(spark, d):
    b = bigrams(table(spark, d, PAR), "pair_id", "ing")
    seen = b.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n >= 2").select("w1", "w2")
    return b.select("w1", "w2").distinct().join(seen, ["w1", "w2"], "left_anti")


@C.add("J19_pair_cosine", "select a.vec_id, round(list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def j19(spark, d):
    e = table(spark, d, "embeddings")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(R.dot(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@C.add("J20_group_similarity", "select a.vec_id as a, b.vec_id as b, round(list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as sim from embeddings a join embeddings b on a.vec_id // 10 = b.vec_id // 10 where a.vec_id % 2 = 0 and b.vec_id % 2 = 1")
def j20(spark, d):
    """Every left with every right sentence of one document (a document is ten vectors here, five a side)."""
    e = table(spark, d, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 10))
    a = e.where("vec_id % 2 = 0").select("doc", F.col("vec_id").alias("a"), F.col("embedding").alias("ea"))
    b = e.where("vec_id % 2 = 1").select("doc", F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return a.join(b, "doc").select("a", "b", F.round(R.dot(F.col("ea"), F.col("eb")), 6).alias("sim"))


@C.add("J21_merge_existing_wins", f"select word, translation, 'main' as origin from {TR_SQL} union all select word, 'new' as translation, 'corpus' as origin from {_DICT} where word not in (select word from {TR_SQL})")
def j21(spark, d):
    main = translations(spark, d).withColumn("origin", F.lit("main"))
    new = dictionary(spark, d).select("word", F.lit("new").alias("translation"), F.lit("corpus").alias("origin"))
    return R.merged(main, new, ["word"])


@C.add("J22_overlay", "select s_suppkey, coalesce(p.v, s.s_acctbal) as s_acctbal from supplier s left join (select c_custkey k, c_acctbal v from customer where c_custkey % 2 = 0) p on s.s_suppkey = p.k")
def j22(spark, d):
    patch = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("s_acctbal"))
    return R.overlay(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), patch, "s_suppkey", ["s_acctbal"])


# ---- aggregations


@C.add("A01_unigrams", f"select word, count(*) as n from (select unnest({_MWI}) word from parallel_ing_rus) where regexp_matches(word, '(?i){P.TOKEN_MARKERS}') group by word having count(*) >= 2")
def a01(spark, d):
    w = table(spark, d, PAR).select(F.explode(W.model_words(F.col("ing"))).alias("word"))
    return w.where(F.col("word").rlike(f"(?iu){P.TOKEN_MARKERS}")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


@C.add("A02_bigrams", f"select w1, w2, count(*) as n from {_BI} group by w1, w2 having count(*) >= 2")
def a02(spark, d):
    return bigrams(table(spark, d, PAR), "pair_id", "ing").groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n >= 2")


@C.add("A03_model_totals", f"select sum(n) as total_tokens, count(*) as vocabulary from (select count(*) n from (select unnest({_MWI}) word from parallel_ing_rus) where regexp_matches(word, '(?i){P.TOKEN_MARKERS}') group by word having count(*) >= 2)")
def a03(spark, d):
    return a01(spark, d).agg(F.sum("n").alias("total_tokens"), F.count("*").alias("vocabulary"))


@C.add("A04_count_by_type", "select pair_type, count(*) as n from parallel_ing_rus group by pair_type")
def a04(spark, d):
    return table(spark, d, PAR).groupBy("pair_type").agg(F.count("*").alias("n"))


@C.add("A05_segment_stats", "select doc_id, len(l) as total, len(list_filter(l, lambda x: length(x) > 30)) as good from (select doc_id, string_split(text, chr(10)) l from documents where text is not null)")
def a05(spark, d):
    l = F.split("text", "\n")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(l).alias("total"), F.size(F.filter(l, lambda x: F.length(x) > 30)).alias("good"))


@C.add("A06_sums", "select sum(coalesce(length(text), 0)) as chars, (select sum(file_size) from download_state) as bytes from mono")
def a06(spark, d):
    return table(spark, d, "mono").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars")).crossJoin(table(spark, d, "download_state").agg(F.sum("file_size").alias("bytes")))


_B = P.SCORE_BUCKETS


@C.add("A07_score_histogram", f"""
with b as (select unnest(range(0, 6)) bucket), s as (select case {' '.join(f'when lang_score < {hi} then {i}' for i, hi in enumerate(_B[1:]))} else 5 end bucket from mono where lang_score is not null)
select b.bucket, count(s.bucket) as n from b left join s using (bucket) group by b.bucket""")
def a07(spark, d):
    bucket = F.lit(5)
    for i, hi in reversed(list(enumerate(_B[1:]))):
        bucket = F.when(F.col("lang_score") < hi, i).otherwise(bucket)
    counts = table(spark, d, "mono").where("lang_score is not null").groupBy(bucket.cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))
    return spark.range(6).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@C.add("A08_removed_by_source", "select source, count(*) as n from parallel_ing_rus where length(ing) < 40 group by source order by n desc, source limit 20")
def a08(spark, d):
    return table(spark, d, PAR).where("length(ing) < 40").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("source").asc_nulls_last()).limit(20)


@C.add("A09_distinct_counts", f"select (select count(*) from {_DICT}) as words, (select count(distinct slug) from book_catalog) as slugs")
def a09(spark, d):
    return dictionary(spark, d).agg(F.count("*").alias("words")).crossJoin(table(spark, d, BOOK).agg(F.countDistinct("slug").alias("slugs")))


@C.add("A10_dedup_min_priority", "select slug, priority, title from (select slug, priority, title, row_number() over (partition by slug order by priority, title, download_count) n from book_catalog) where n = 1")
def a10(spark, d):
    return R.first_per_key(table(spark, d, BOOK), ["slug"], F.col("priority").asc_nulls_last(), F.col("title").asc_nulls_last(), F.col("download_count").asc_nulls_last()).select("slug", "priority", "title")


@C.add("A11_keep_longest", "select source, mono_id from (select source, mono_id, row_number() over (partition by source order by length(text) desc nulls last, mono_id) n from mono) where n = 1")
def a11(spark, d):
    return R.first_per_key(table(spark, d, "mono"), ["source"], F.length("text").desc_nulls_last(), "mono_id").select("source", "mono_id")


@C.add("A12_most_frequent", "select ing, rus from (select ing, rus, row_number() over (partition by ing order by count(*) desc, min(pair_id)) n from parallel_ing_rus where pair_type = 'word_pair' and ing is not null and rus is not null group by ing, rus) where n = 1")
def a12(spark, d):
    t = table(spark, d, PAR).where("pair_type = 'word_pair' and ing is not null and rus is not null").groupBy("ing", "rus").agg(F.count("*").alias("n"), F.min("pair_id").alias("first"))
    return R.first_per_key(t, ["ing"], F.desc("n"), "first").select("ing", "rus")


@C.add("A13_bounding_box", "select min(s_acctbal) as lat0, max(s_acctbal) as lat1, min(s_nationkey) as lon0, max(s_nationkey) as lon1 from supplier where s_acctbal is not null and s_acctbal <> 0")
def a13(spark, d):
    return table(spark, d, "supplier").where("s_acctbal is not null and s_acctbal <> 0").agg(F.min("s_acctbal").alias("lat0"), F.max("s_acctbal").alias("lat1"), F.min("s_nationkey").alias("lon0"), F.max("s_nationkey").alias("lon1"))


@C.add("A14_mean_chars", "select source, round(avg(length(text)), 3) as mean_chars, round(sum(length(text)) / cast(count(*) as double), 1) as per_row from mono where text is not null group by source")
def a14(spark, d):
    return table(spark, d, "mono").where("text is not null").groupBy("source").agg(F.round(F.avg(F.length("text")), 3).alias("mean_chars"), F.round(F.sum(F.length("text")) / F.count("*"), 1).alias("per_row"))


@C.add("A15_marker_ratio", f"select source, round(avg({SCORE_SQL}), 6) as ratio from mono where text is not null group by source")
def a15(spark, d):
    return table(spark, d, "mono").where("text is not null").groupBy("source").agg(F.round(F.avg(W.language_score(F.col("text"))), 6).alias("ratio"))


@C.add("A16_status", f"select (select count(*) from {_DICT}) as dictionary_size, (select count(*) from (select w1, w2 from {_BI} group by w1, w2 having count(*) >= 2)) as bigram_count")
def a16(spark, d):
    return dictionary(spark, d).agg(F.count("*").alias("dictionary_size")).crossJoin(a02(spark, d).agg(F.count("*").alias("bigram_count")))


@C.add("A17_coverage", f"select count(*) as expected, count(case when ing is not null and rus is not null then 1 end) as ok, count(case when ing is null then 1 end) as missing_ing, count(case when rus is null then 1 end) as missing_rus from ({C.sql['J03_expected_grid']})")
def a17(spark, d):
    return j03(spark, d).agg(F.count("*").alias("expected"), F.count_if(F.col("ing").isNotNull() & F.col("rus").isNotNull()).alias("ok"), F.count_if(F.col("ing").isNull()).alias("missing_ing"), F.count_if(F.col("rus").isNull()).alias("missing_rus"))


@C.add("A19_nested_response", f"""
with t as (select mono_id, word, row_number() over (partition by mono_id order by word) n from (select distinct mono_id, word from {_TOK} where word not in (select word from {_DICT})))
select mono_id, count(*) as n_words, string_agg(word, '|' order by word) as words from t group by mono_id""")
def a19(spark, d):
    t = j06(spark, d).distinct().groupBy("mono_id").agg(F.array_sort(F.collect_list(F.struct("word"))).alias("c"))
    return t.select("mono_id", F.size("c").cast("bigint").alias("n_words"), F.array_join(F.transform("c", lambda x: x["word"]), "|").alias("words"))


# ---- windows


@C.add("W01_first_wins", "select pair_id from (select pair_id, row_number() over (partition by ing order by pair_id) n from parallel_ing_rus where ing is not null) where n = 1")
def w01(spark, d):
    return R.first_per_key(table(spark, d, PAR).where("ing is not null").select("pair_id", "ing"), ["ing"], "pair_id").select("pair_id")


@C.add("W02_adjacent_bigrams", f"select doc as pair_id, w1, w2 from {_BI}")
def w02(spark, d):
    return bigrams(table(spark, d, PAR), "pair_id", "ing")


_PSPLIT = f"list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda p: {s_strip('p')}), lambda p: length(p) > 30)"


@C.add("W03_greedy_pairs", f"""
with p as (select mono_id, unnest({_PSPLIT}) as text, generate_subscripts({_PSPLIT}, 1) as pos from mono where text is not null),
k as (select mono_id, pos, text, {CLASS_SQL} as cls from p), e as (select *, lead(cls) over w c2, lead(text) over w t2 from k window w as (partition by mono_id order by pos)),
c as (select *, pos - row_number() over (partition by mono_id order by pos) isl from (select *, (case when cls = 'ing' then length(text) else length(t2) end) / cast(greatest(case when cls = 'ing' then length(t2) else length(text) end, 1) as double) r from e where (cls = 'ing' and c2 = 'rus') or (cls = 'rus' and c2 = 'ing')) where r > 0.4 and r < 2.5),
q as (select *, row_number() over (partition by mono_id, isl order by pos) rk from c)
select mono_id, case when cls = 'ing' then text else t2 end as ing, case when cls = 'ing' then t2 else text end as rus from q where rk % 2 = 1""")
def w03(spark, d):
    return bilingual_paragraphs(table(spark, d, "mono"), "mono_id", "text")


def bilingual_paragraphs(df, key, col):
    """(key, ing, rus): neighbouring paragraphs in either language of like length, each paragraph in one pair."""
    p = df.where(F.col(col).isNotNull()).select(key, F.posexplode(W.paragraphs(F.col(col))).alias("pos", "t")).withColumn("cls", W.classify(F.col("t")))
    w = Window.partitionBy(key).orderBy("pos")
    p = p.withColumn("c2", F.lead("cls").over(w)).withColumn("t2", F.lead("t").over(w))
    first = F.col("cls") == "ing"
    p = p.withColumn("ing", F.when(first, F.col("t")).otherwise(F.col("t2"))).withColumn("rus", F.when(first, F.col("t2")).otherwise(F.col("t")))
    match = ((first & (F.col("c2") == "rus")) | ((F.col("cls") == "rus") & (F.col("c2") == "ing"))) & O.ratio_between(F.col("ing"), F.col("rus"))
    return R.disjoint_pairs(p, [key], "pos", F.coalesce(match, F.lit(False))).select(key, "ing", "rus")


@C.add("W04_suggestion_rank", f"""
with f as (select word, count(*) freq from (select unnest({_MWI}) word from parallel_ing_rus) group by word),
j as (select c.word, t.word cand, {LEV} dist, coalesce(f.freq, 0) freq from {_CW} c join {TR_SQL} t on {LEV} <= 2 left join f on f.word = t.word)
select word, cand as candidate, n as rank from (select *, row_number() over (partition by word order by dist, freq desc, cand) n from j) where n <= 5""")
def w04(spark, d):
    freq = table(spark, d, PAR).select(F.explode(W.model_words(F.col("ing"))).alias("candidate")).groupBy("candidate").agg(F.count("*").alias("freq"))
    j = j12(spark, d).join(freq, "candidate", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    return R.top_per_key(j, ["word"], 5, "distance", F.desc("freq"), "candidate").select("word", "candidate", "rank")


C.add("W05_related_rank", C.sql["J15_related_words"])(j15)


@C.add("W06_hashed_split", """
with r as (select pair_id, row_number() over (order by md5('42|' || pair_id), pair_id) k, count(*) over () n from parallel_ing_rus)
select pair_id, case when k <= greatest(100, floor(n * 5 / 100)) then 'test' when k <= 2 * greatest(100, floor(n * 5 / 100)) then 'dev' else 'train' end as split from r""")
def w06(spark, d):
    return R.hashed_rank_split(table(spark, d, PAR).select("pair_id"), "pair_id", 42, 5, 5)


_HEAD = f"case when regexp_matches({s_strip('line')}, '^[\\p{{Lu}}\\p{{Zs}}ӀI]{{3,}}$') then {s_strip('line')} end"


@C.add("W07_running_heading", f"""
with l as (select mono_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as line from mono where text is not null)
select mono_id, pos, last_value({_HEAD} ignore nulls) over (partition by mono_id order by pos) as heading from l""")
def w07(spark, d):
    """The last heading above each line, carried forward."""
    lines = table(spark, d, "mono").where("text is not null").select("mono_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.when(S.strip(F.col("line")).rlike("^[\\p{Lu}\\p{Zs}ӀI]{3,}$"), S.strip(F.col("line")))
    return lines.withColumn("heading", F.last(head, ignorenulls=True).over(Window.partitionBy("mono_id").orderBy("pos"))).select("mono_id", "pos", "heading")


@C.add("W08_latest_state", "select slug, entry_id, status from (select slug, entry_id, status, row_number() over (partition by slug order by logged_at desc, entry_id desc) n from download_state) where n = 1")
def w08(spark, d):
    return R.first_per_key(table(spark, d, "download_state"), ["slug"], F.desc("logged_at"), F.desc("entry_id")).select("slug", "entry_id", "status")


@C.add("W09_era_counts", "select case when y < 1995 then 'early' when y < 1999 then 'middle' else 'late' end as era, count(*) as n from (select coalesce(year(o_orderdate), 0) y from orders) group by era")
def w09(spark, d):
    return j14(spark, d).groupBy("era").agg(F.count("*").alias("n"))


@C.add("W10_streak_stop", """
with e as (select user_id, event_id, case when value < 20 then 1 else 0 end e from events), g as (select *, sum(1 - e) over (partition by user_id order by event_id) g from e),
s as (select *, sum(e) over (partition by user_id, g order by event_id) s from g), x as (select *, max(case when s >= 2 then 1 else 0 end) over (partition by user_id order by event_id) x from s)
select event_id from x where x = 0""")
def w10(spark, d):
    return R.streak_stop(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", F.col("value") < 20, 2).select("event_id")


# ---- sorts, limits, sets


@C.add("T01_sorted_page", f"select word from {_DICT} order by word limit 50 offset 50")
def t01(spark, d):
    return dictionary(spark, d).orderBy("word").offset(50).limit(50)


@C.add("T02_total_pages", f"select cast(ceil(count(*) / 50.0) as bigint) as pages from {_DICT}")
def t02(spark, d):
    return dictionary(spark, d).agg(F.ceil(F.count("*") / 50).alias("pages"))


@C.add("T03_top_downloads", "select slug, n from (select slug, max(download_count) n from book_catalog group by slug) order by n desc nulls last, slug limit 10")
def t03(spark, d):
    return table(spark, d, BOOK).groupBy("slug").agg(F.max("download_count").alias("n")).orderBy(F.desc_nulls_last("n"), "slug").limit(10)


@C.add("T04_sorted_unigrams", C.sql["A01_unigrams"])
def t04(spark, d):
    return a01(spark, d).orderBy(F.desc("n"), "word")


@C.add("T05_by_year", "select o_orderkey, year(o_orderdate) as y from orders")
def t05(spark, d):
    return table(spark, d, "orders").select("o_orderkey", YEAR().alias("y")).orderBy("y", "o_orderkey")


@C.add("T06_lowest_scores", "select mono_id, lang_score from mono where lang_score is not null order by lang_score, mono_id limit 8")
def t06(spark, d):
    return table(spark, d, "mono").where("lang_score is not null").select("mono_id", "lang_score").orderBy("lang_score", "mono_id").limit(8)


@C.add("T07_multi_key_sort", "select distinct slug, priority, category_slug from book_catalog")
def t07(spark, d):
    return table(spark, d, BOOK).select("slug", "priority", "category_slug").distinct().orderBy("priority", "category_slug", "slug")


@C.add("T08_show_limit", "select source, mono_id, greatest(c - 3, 0) as remaining from (select source, mono_id, row_number() over (partition by source order by mono_id) n, count(*) over (partition by source) c from mono) where n <= 3")
def t08(spark, d):
    """The first three rows of each source and how many more there are; the count is a separate aggregate, so a hot source isn't held in one window."""
    m = table(spark, d, "mono").select("source", "mono_id")
    top = R.top_per_key(m, ["source"], 3, "mono_id", rank="n")
    counts = m.groupBy("source").agg(F.count("*").alias("c"))
    return top.join(counts, top["source"].eqNullSafe(counts["source"])).select(top["source"], "mono_id", F.greatest(F.col("c") - 3, F.lit(0)).alias("remaining"))


_CK = "select c_nationkey as k from customer where c_acctbal > 0"
_SK = "select s_nationkey as k from supplier where s_acctbal > 5000"


def _sides(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))


@C.add("U01_union", f"select word from {_DICT} union select word from {TR_SQL}")
def u01(spark, d):
    return dictionary(spark, d).union(translations(spark, d).select("word")).distinct()


@C.add("U02_difference", f"{_CK} except {_SK}")
def u02(spark, d):
    a, b = _sides(spark, d)
    return a.subtract(b)


@C.add("U03_intersection", f"{_CK} intersect {_SK}")
def u03(spark, d):
    a, b = _sides(spark, d)
    return a.intersect(b)


@C.add("U04_bag_union", "select source, cast(null as varchar) as pair_type from mono union all select source, pair_type from parallel_ing_rus")
def u04(spark, d):
    return table(spark, d, "mono").select("source").unionByName(table(spark, d, PAR).select("source", "pair_type"), allowMissingColumns=True)


@C.add("U05_kept_parts", "select pair_id from parallel_ing_rus where pair_type = 'verse' or length(ing) > 60")
def u05(spark, d):
    p = table(spark, d, PAR)
    return p.where("pair_type = 'verse'").select("pair_id").unionByName(p.where("coalesce(pair_type, '') <> 'verse' and length(ing) > 60").select("pair_id"))


@C.add("U06_distinct_in_order", "select source, min(mono_id) as first_id from mono group by source")
def u06(spark, d):
    return table(spark, d, "mono").groupBy("source").agg(F.min("mono_id").alias("first_id")).orderBy("first_id")


QUERIES, SQL = C.queries, C.sql
