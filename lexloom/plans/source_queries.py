"""Queries over sources (S) and sinks (K).  File formats are made from the tables, so the readers run as on files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import strings as S
from lexloom.operators import relations as R
from lexloom.sources import catalog as CA
from lexloom.sources import lines as L
from lexloom.sources import sinks as K

from .base import Catalogue, lit, s_strip, table
from .relational_queries import TR_SQL, dictionary, translations, _DICT

C = Catalogue()
PAR, BOOK = "parallel_ing_rus", "book_catalog"


def pair_lines(spark, d, broken: bool = False):
    """Pairs as JSON lines with a comment or a blank line after some of them, and broken ones on demand."""
    p = table(spark, d, PAR)
    js = F.to_json(F.struct("pair_id", "ing", "rus", "num"), {"ignoreNullFields": "false"})
    extra = F.when(F.col("pair_id") % 7 == 0, F.lit("### source: x")).when(F.col("pair_id") % 7 == 1, F.lit("   ")).when((F.col("pair_id") % 7 == 2) & F.lit(broken), F.concat(F.lit('{"pair_id": '), "pair_id", F.lit(', "ing": "cut')))
    return p.select(F.explode(F.array_compact(F.array(js, extra))).alias("value"))


PAIR_SCHEMA = "pair_id bigint, ing string, rus string, num int"


@C.add("S01_jsonl_scan", "select pair_id, ing, rus, num from parallel_ing_rus")
def s01(spark, d):
    return L.jsonl_strict(pair_lines(spark, d), PAIR_SCHEMA)


@C.add("S02_jsonl_tolerant", "select pair_id, ing, rus, num from parallel_ing_rus")
def s02(spark, d):
    return L.jsonl(pair_lines(spark, d, broken=True), PAIR_SCHEMA)


@C.add("S03_catalog_last_wins", "select slug, title from (select slug, title, row_number() over (partition by slug order by download_count desc nulls last, title desc) n from book_catalog) where n = 1")
def s03(spark, d):
    """By the greatest row order; here the order is the download count."""
    return R.first_per_key(table(spark, d, BOOK), ["slug"], F.col("download_count").desc_nulls_last(), F.col("title").desc_nulls_last()).select("slug", "title")


@C.add("S04_word_list", f"select distinct lower({s_strip('word')}) as word from translations where word is not null and not regexp_matches(word, '^\\s*(#|$)') and {s_strip('word')} <> ''")
def s04(spark, d):
    lines = table(spark, d, "translations").select(F.concat(F.lit("  "), "word", F.lit("\t")).alias("value")).where("value is not null")
    return L.word_list(lines.unionByName(spark.createDataFrame([("# comment",), (" ",)], "value string")))


@C.add("S05_json_map", f"select word as key, translation as value from {TR_SQL}")
def s05(spark, d):
    """One JSON object per first letter."""
    t = translations(spark, d)
    docs = t.groupBy(F.substring("word", 1, 1).alias("k")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("word", "translation")))).alias("value"))
    return L.json_map(docs.select("value"))


@C.add("S06_ngram_model", "select 'a b' as bigram, num as c, 2 * num as total from (select distinct num from parallel_ing_rus where num is not null)")
def s06(spark, d):
    n = table(spark, d, PAR).where("num is not null").select("num").distinct()
    docs = n.select(F.concat(F.lit('{"totalTokens": '), F.col("num") * 2, F.lit(', "unigrams": {"a": '), "num", F.lit('}, "bigrams": {"a b": '), "num", F.lit("}}")).alias("value"))
    uni, bi, total = L.ngram_model(docs)
    return bi.join(total, F.col("c") * 2 == F.col("total_tokens")).select(F.concat_ws(" ", "w1", "w2").alias("bigram"), "c", F.col("total_tokens").alias("total"))


@C.add("S07_documents_with_catalog", "select m.mono_id, coalesce(c.category_slug, 'unknown') as category_slug from mono m left join (select slug, min(category_slug) category_slug from book_catalog group by slug) c on m.source = c.slug where octet_length(encode(m.text)) > 100")
def s07(spark, d):
    cat = table(spark, d, BOOK).groupBy(F.col("slug").alias("source")).agg(F.min("category_slug").alias("category_slug"))
    return table(spark, d, "mono").where(F.octet_length("text") > 100).join(cat, "source", "left").select("mono_id", F.coalesce("category_slug", F.lit("unknown")).alias("category_slug"))


@C.add("S08_scan_order", "select distinct slug, coalesce(priority, 9) as priority, download_count from book_catalog")
def s08(spark, d):
    return table(spark, d, BOOK).select("slug", F.coalesce("priority", F.lit(9)).alias("priority"), "download_count").distinct().orderBy("priority", F.desc_nulls_last("download_count"), "slug")


@C.add("S09_table_by_id", "select * from supplier where s_suppkey = 7")
def s09(spark, d):
    return table(spark, d, "supplier").where("s_suppkey = 7")


@C.add("S10_schema_and_seed", "select 1 as id, 1817 as year, 'Founding' as title union all select 2, 1944, 'Removal' union all select 3, null, 'Undated'")
def s10(spark, d):
    """Declared schema with seed rows."""
    return spark.createDataFrame([(1, 1817, "Founding"), (2, 1944, "Removal"), (3, None, "Undated")], "id int not null, year int, title string not null")


@C.add("S11_script_array", "select pair_id, ing as b, rus as d from parallel_ing_rus where ing is not null and rus is not null")
def s11(spark, d):
    p = table(spark, d, PAR).where("ing is not null and rus is not null")
    js = F.concat(F.lit("// x\nvar allData = ["), F.to_json(F.struct(F.col("ing").alias("b"), F.col("rus").alias("d"))), F.lit(", ];\n"))
    return p.select("pair_id", F.explode(L.literal_array(js, "allData", "b: string, d: string")).alias("r")).select("pair_id", "r.b", "r.d")


@C.add("S12_html_pages", "select slug, title from book_catalog where title is not null")
def s12(spark, d):
    page = F.concat(F.lit("<html><body><h1>"), "title", F.lit("</h1></body></html>"))
    return table(spark, d, BOOK).where("title is not null").select("slug", S.article(page)["title"].alias("title"))


@C.add("S13_catalog_table", "select distinct slug, trim(title) as title, coalesce(download_count, 0) as download_count, upload_date, file_size from book_catalog where title is not null and file_size is not null and upload_date is not null")
def s13(spark, d):
    b = table(spark, d, BOOK).where("title is not null and file_size is not null and upload_date is not null")
    row = F.concat(F.lit("<table><tr class=x><td><a href='/"), "slug", F.lit("/'>"), "title", F.lit("</a></td><td>"), "file_size", F.lit("</td><td>"), F.coalesce("download_count", F.lit(0)), F.lit(" загрузок</td><td>"), "upload_date", F.lit("</td></tr><tr><td>no link</td></tr></table>"))
    rows = b.select("slug", F.explode(CA.catalog_rows(row)).alias("r"))
    return rows.select("slug", "r.title", "r.download_count", "r.upload_date", "r.file_size").distinct()


_PG = "(select mono_id // 50 as listing, mono_id, case when mono_id % 4 = 0 or mono_id % 9 = 1 then 0 else 1 end as n from mono)"


def landed(spark, d):
    """Landed pages of listings of up to fifty pages; some are empty."""
    items = F.when((F.col("mono_id") % 4 == 0) | (F.col("mono_id") % 9 == 1), F.array().cast("array<string>")).otherwise(F.array("category"))
    return table(spark, d, "mono").select(F.floor(F.col("mono_id") / 50).alias("listing"), "mono_id", items.alias("items"))


@C.add("S14_cursor_scan", f"""
with e as (select listing, mono_id, 1 - n as e from {_PG}), g as (select *, sum(1 - e) over (partition by listing order by mono_id) g from e), s as (select *, sum(e) over (partition by listing, g order by mono_id) s from g),
x as (select *, max(case when s >= 2 then 1 else 0 end) over (partition by listing order by mono_id) x from s) select listing, mono_id from x where x = 0""")
def s14(spark, d):
    m = landed(spark, d)
    return CA.cursor_pages(m, "listing", "mono_id", "items", 2).select("listing", "mono_id")


@C.add("S15_page_numbers", C.sql["S14_cursor_scan"].replace("s >= 2", "s >= 1"))
def s15(spark, d):
    m = landed(spark, d)
    return CA.cursor_pages(m, "listing", "mono_id", "items", 1).select("listing", "mono_id")


@C.add("S16_sniff_and_md5", "select entry_id, case entry_id % 3 when 0 then 'pdf' when 1 then 'png' else 'unknown' end as format, md5(concat(case entry_id % 3 when 0 then '%PDF' when 1 then 'PNG!' else 'text' end, coalesce(slug, ''))) as md5 from download_state")
def s16(spark, d):
    k = F.col("entry_id") % 3
    body = F.concat(F.when(k == 0, "%PDF").when(k == 1, "PNG!").otherwise("text"), F.coalesce("slug", F.lit("")))
    content = F.when(k == 1, F.concat(F.unhex(F.lit("89504E47")), F.encode("slug", "UTF-8"))).otherwise(F.encode(body, "UTF-8"))
    return table(spark, d, "download_state").select("entry_id", L.sniff(content).alias("format"), F.md5(F.encode(body, "UTF-8")).alias("md5"))


@C.add("S17_text_layer", "select source, round(avg(coalesce(length(text), 0)), 6) as mean_chars, avg(coalesce(length(text), 0)) >= 400 as has_text from (select *, row_number() over (partition by source order by mono_id) n from mono where source is not null) where n <= 10 group by source")
def s17(spark, d):
    m = R.top_per_key(table(spark, d, "mono").where("source is not null"), ["source"], 10, "mono_id", rank="n")
    return CA.text_layer(m.withColumn("n", F.col("n") - 1), "source", "n", "text", 10, 400.0).withColumn("mean_chars", F.round("mean_chars", 6))


@C.add("S18_external_extraction")
def s18(spark, d):
    """The seam for page recognition: here the recogniser only counts bytes."""
    import pyarrow as pa

    def recognise(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x or b"") for x in b.column(1).to_pylist()], pa.int32())], names=["mono_id", "n"])

    return CA.external(table(spark, d, "mono").select("mono_id", F.encode("text", "UTF-8").alias("content")), recognise, "mono_id bigint, n int")


def _beyond(charset: str, escape: str) -> str:
    """Pattern of a character that the charset hasn't got."""
    held = sorted(ord(c) for c in bytes(range(256)).decode(charset, "ignore"))
    return "[^" + "".join(escape % c for c in held) + "]"


@C.add("S19_charsets", f"select pair_id, case when pair_id % 2 = 0 then regexp_replace(rus, '{_beyond('koi8-r', '\\x{%x}')}', '?', 'g') else regexp_replace(rus, '{_beyond('cp1251', '\\x{%x}')}', '?', 'g') end as rus from parallel_ing_rus where rus is not null")
def s19(spark, d):
    """Every text written and read in a charset; what the charset hasn't got comes back as a question mark."""
    p = table(spark, d, PAR).where("rus is not null")
    made = [L.decoded(L.encoded(F.regexp_replace("rus", _beyond(c, "\\x{%x}"), "?"), c), c) for c in ("koi8-r", "cp1251")]
    return p.select("pair_id", F.when(F.col("pair_id") % 2 == 0, made[0]).otherwise(made[1]).alias("rus"))


@C.add("S20_fallback_chain", "select source, text from (select source, text, row_number() over (partition by source order by mono_id) n from mono where length(text) > 300 and source is not null) where n = 1")
def s20(spark, d):
    return CA.first_long_enough(table(spark, d, "mono").where("source is not null"), "source", "mono_id", "text", 300)


@C.add("S21_pages_until_short", """
with s as (select mono_id // 10 as doc, mono_id, text, max(case when coalesce(length(text), 0) < 120 then 1 else 0 end) over (partition by mono_id // 10 order by mono_id) x from mono)
select doc, string_agg(text, chr(10) order by mono_id) as text from s where x = 0 group by doc""")
def s21(spark, d):
    """Documents of ten pages."""
    return CA.pages_until_short(table(spark, d, "mono").withColumn("doc", F.floor(F.col("mono_id") / 10)), "doc", "mono_id", "text", 120)


# ---- sinks


def _written(spark, df, name: str, schema: str, mode_rounds: int = 1):
    """Write to a folder of the session, read back: what a sink leaves.

    The folder lies in the one that the cluster names; only where none is named (tests) it is a temporary one, removed at the end.
    """
    import atexit
    import shutil
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = tempfile.mkdtemp(prefix="lexloom-sink-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    path = f"{base}/{spark.sparkContext.applicationId}-{name}"
    for k in range(mode_rounds):
        K.write_jsonl(df, path, append=k > 0)
    return spark.read.schema(schema).json(path)


@C.add("K01_jsonl_overwrite", "select pair_id, rus from parallel_ing_rus")
def k01(spark, d):
    return _written(spark, table(spark, d, PAR).select("pair_id", "rus"), "K01", "pair_id bigint, rus string")


@C.add("K02_jsonl_append", "select slug, status from download_state union all select slug, status from download_state")
def k02(spark, d):
    return _written(spark, table(spark, d, "download_state").select("slug", "status"), "K02", "slug string, status string", 2)


@C.add("K03_replace_by_source", "select pair_id, source from parallel_ing_rus where source is null or source <> 'dictionary' union all select pair_id + 1000000, source from parallel_ing_rus where source = 'dictionary' and pair_id % 2 = 0")
def k03(spark, d):
    p = table(spark, d, PAR).select("pair_id", "source")
    new = p.where("source = 'dictionary' and pair_id % 2 = 0").withColumn("pair_id", F.col("pair_id") + 1000000)
    return K.replace_values(p, new, "source", ["dictionary"])


@C.add("K04_replace_by_source_and_type", """
with n as (select source, pair_type, pair_id + 1000000 as pair_id from parallel_ing_rus where pair_type = 'verse' and source like 'epos%')
select o.pair_id, o.source, o.pair_type from parallel_ing_rus o where not exists (select 1 from n where n.source = o.source and n.pair_type = o.pair_type) union all select pair_id, source, pair_type from n""")
def k04(spark, d):
    p = table(spark, d, PAR).select("pair_id", "source", "pair_type")
    return K.replace_by(p, p.where("pair_type = 'verse' and source like 'epos%'").withColumn("pair_id", F.col("pair_id") + 1000000), ["source", "pair_type"]).select("pair_id", "source", "pair_type")


@C.add("K05_skip_existing", "select mono_id from mono where source is null or source not in (select source from parallel_ing_rus where source is not null)")
def k05(spark, d):
    return K.new_sources(table(spark, d, "mono"), table(spark, d, PAR)).select("mono_id")


@C.add("K06_word_file", f"select '# words' as value union all select word from {_DICT}")
def k06(spark, d):
    return K.word_file(dictionary(spark, d), "words")


@C.add("K07_state_log", "select slug, max(logged_at) as last, count(*) as n from download_state group by slug")
def k07(spark, d):
    return table(spark, d, "download_state").groupBy("slug").agg(F.max("logged_at").alias("last"), F.count("*").alias("n"))


@C.add("K08_valid_suggestions", f"select {s_strip('word')} as word, {s_strip('translation')} as translation from translations where {s_strip('word')} <> '' and {s_strip('translation')} <> ''")
def k08(spark, d):
    return K.valid_suggestions(table(spark, d, "translations").select("word", "translation"))


@C.add("K09_report", "select concat(coalesce(category_slug, '-'), ': ', count(*)) as line from book_catalog group by category_slug")
def k09(spark, d):
    return K.report(table(spark, d, BOOK).groupBy("category_slug").agg(F.count("*").alias("n")), "category_slug", "n")


@C.add("K10_split_files", "select case when k <= greatest(100, floor(n * 5 / 100)) then 'test' when k <= 2 * greatest(100, floor(n * 5 / 100)) then 'dev' else 'train' end as split, count(*) as n_rows from (select row_number() over (order by md5('42|' || pair_id), pair_id) k, count(*) over () n from parallel_ing_rus) group by split")
def k10(spark, d):
    return R.hashed_rank_split(table(spark, d, PAR).select("pair_id"), "pair_id", 42, 5, 5).groupBy("split").agg(F.count("*").alias("n_rows"))


@C.add("K11_dry_run", "select count(*) as before, count(case when length(ing) >= 15 then 1 end) as after from parallel_ing_rus")
def k11(spark, d):
    return table(spark, d, PAR).agg(F.count("*").alias("before"), F.count_if(F.length("ing") >= 15).alias("after"))


QUERIES, SQL = C.queries, C.sql
