"""Queries over the string functions (F), tokenisers and segmenters (G) and measures (L01, L02, L12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import profile as P
from lexloom.functions import strings as S
from lexloom.functions import words as W
from lexloom.sources import html as H

from .base import Catalogue, lit, s_replace, s_squeeze, s_strip, s_sub, table

C = Catalogue()
_W = P.WS
K, KB = P.CONSONANTS, P.CONSONANTS_BOTH
RAW_HTML = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def over(name: str, tab: str, key: str, col: str, fn, expr: str, out: str = "value"):
    """A function over one column of a table: (key, out)."""

    def query(spark, d):
        return table(spark, d, tab).select(key, fn(F.col(col)).alias(out))

    C.add(name, f"select {key}, {expr} as {out} from {tab}")(query)


def twice(e: str, pattern: str, to: str) -> str:
    return s_sub(s_sub(e, pattern, to), pattern, to)


_A = s_sub("replace(ing, 'Ӏ', 'ӏ')", f"([{K}])I", "\\1ӏ")
over("F01_normalize_palochka", "parallel_ing_rus", "pair_id", "ing", S.normalize_palochka, twice(_A, f"([{K}])1([а-яёӏ])", "\\1ӏ\\2"))
_B = twice("replace(ing, 'Ӏ', 'ӏ')", f"([{KB}])I([а-яёӏ{_W}\\n,.!?\\-]|$)", "\\1ӏ\\2")
_B = twice(twice(_B, f"([{KB}])I([А-ЯЁ])", "\\1ӏ\\2"), f"([{KB}])1([{P.VOWELS_BOTH}])", "\\1ӏ\\2")
over("F02_normalize_palochka_scan", "parallel_ing_rus", "pair_id", "ing", S.normalize_palochka_scan, twice(s_sub(_B, f"([{KB}])\\|", "\\1ӏ"), "([гкхГКХ])[I1l|]([аео])", "\\1ӏ\\2"))
_C = twice("replace(ing, 'Ӏ', 'ӏ')", f"(?i)([{K}])г([аеёиоуыьъяю])", "\\1ӏ\\2")
over("F03_normalize_palochka_loose", "parallel_ing_rus", "pair_id", "ing", S.normalize_palochka_loose, twice(twice(_C, f"([{K}])1([а-яёА-ЯЁ])", "\\1ӏ\\2"), f"([{K}])I([а-яёА-ЯЁ])", "\\1ӏ\\2"))
over("F04_normalize_palochka_letters", "parallel_ing_rus", "pair_id", "ing", lambda c: S.normalize_palochka(c, digits=False), _A)

_scan = s_sub(s_sub("text", f"[{_W}]+", " "), "\\n{3,}", "\n\n")
_scan = s_sub(_scan, "-\\n([а-яёӏА-ЯЁ])", "\\1")
_scan = s_sub(_scan, "[^\\x{400}-\\x{4FF}\\x20-\\x7E\\x{A0}\\n\\t]")
over("F05_clean_scan", "mono", "mono_id", "text", S.clean_scan, s_strip(s_sub(_scan, f"(?m)^[{_W}\\n]*[А-ЯЁа-яё][{_W}\\n]*$")))
over("F06_fix_html", "parallel_ing_rus", "pair_id", "rus", S.fix_html, s_strip(s_sub(s_sub(s_replace("rus", P.ENTITIES), "<[^>]{1,30}>", " "), "[ \\t]+", " ")))
_strip1 = s_squeeze(s_replace(s_sub("text", "<[^>]+>", " "), RAW_HTML))
over("F07_strip_html", "documents", "doc_id", "text", S.strip_html, _strip1)
_p = s_replace("text", (("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&laquo;", "«"), ("&raquo;", "»"), ("&hellip;", "…")))
_p = s_sub(s_sub(s_sub(_p, "&[a-zA-Z]+;"), "<[^>]+>", " "), "[ \\t]+", " ")
_paras = s_strip(s_sub(_p, f"\\n[{_W}\\n]*\\n[{_W}\\n]*\\n+", "\n\n"))
over("F08_strip_html_paragraphs", "documents", "doc_id", "text", S.strip_html_paragraphs, _paras)
over("F10_strip_html_entry", "parallel_ing_rus", "pair_id", "rus", S.strip_html, _strip1.replace("text", "rus"))


@C.add("F09_html_parser")
def f09(spark, d):
    return H.visible_text(table(spark, d, "documents"), "doc_id", "text")


@C.add("F12_container_paragraphs")
def f12(spark, d):
    page = F.concat(F.lit('<p>outside of it</p><div class="cm-single-description"><p>'), F.col("rus"), F.lit("</p><div><p>inner paragraph</p></div></div><p>after it all</p>"))
    return H.container_paragraphs(table(spark, d, "parallel_ing_rus").select("pair_id", page.alias("html")), "pair_id", "html")


_PAGE = "concat('<h1 class=a> <b>', category, '</b></h1><script>var p=''<p>no</p>'';</script><p>', text, '</p><P>too short</P><style>p</style>')"


@C.add("F11_article", f"""
with h as (select doc_id, {_PAGE} h from documents where text is not null)
select doc_id, {s_strip(s_sub("regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1>', 1)", "<[^>]+>"))} as title,
 array_to_string(list_filter(list_transform(regexp_extract_all({s_sub(s_sub("h", "(?is)<script[^>]*>.*?</script>"), "(?is)<style[^>]*>.*?</style>")}, '(?is)<p[^>]*>(.*?)</p>', 1),
 lambda p: {s_sub(s_strip(s_sub("p", "<[^>]+>")), f"[{_W}\\n]+", " ")}), lambda p: length(p) > 30), chr(10) || chr(10)) as text from h""")
def f11(spark, d):
    page = F.concat(F.lit("<h1 class=a> <b>"), "category", F.lit("</b></h1><script>var p='<p>no</p>';</script><p>"), "text", F.lit("</p><P>too short</P><style>p</style>"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", S.article(page).alias("a")).select("doc_id", "a.title", "a.text")


@C.add("F13_tab_text", "select pair_id, " + s_strip(s_sub(_p.replace("text", "substring(h, strpos(h, '>') + 1)"), f"\\n[{_W}\\n]*\\n[{_W}\\n]*\\n+", "\n\n")) + """ as text from
 (select pair_id, substring(concat('<div><ul id="tab1"><li>&laquo;', rus, '</li></ul>'), 10, 30000) h from (select pair_id, rus from parallel_ing_rus where rus is not null))""")
def f13(spark, d):
    page = F.concat(F.lit('<div><ul id="tab1"><li>&laquo;'), "rus", F.lit("</li></ul>"))
    return table(spark, d, "parallel_ing_rus").where("rus is not null").select("pair_id", S.tab_text(page, "tab1").alias("text"))


def _wiki(text: str, source: str) -> str:
    return f"concat('<noinclude>x</noinclude>{{{{a{{{{b}}}}}}}}== ', {source}, ' ==', chr(10), '[[', {source}, '|link]] [[Категория:Нет]] ''''''bold'''''' <ref name=a>no</ref>', chr(10), {text}, '&nbsp;[https://x.y/z label] &#12;')"


def _wiki_col(text: str, source: str):
    return F.expr(_wiki(text, source).replace("''''''", "\\'\\'\\'").replace("chr(10)", "'\\n'"))


def _s_wikitext(e: str) -> str:
    e = s_sub(s_sub(e, "(?is)<noinclude>.*?</noinclude>"), "(?is)<includeonly>.*?</includeonly>")
    e = s_sub(s_sub(e, "\\[\\[Категория:[^\\]]+\\]\\]"), "\\[\\[[a-z]{2,3}:[^\\]]+\\]\\]")
    for _ in range(6):
        e = s_sub(e, "\\{\\{[^{}]*\\}\\}")
    e = s_sub(s_sub(e, "\\[\\[[^\\]|]+\\|([^\\]]+)\\]\\]", "\\1"), "\\[\\[([^\\]]+)\\]\\]", "\\1")
    e = s_sub(s_sub(e, "\\[https?://\\S+\\s+([^\\]]+)\\]", "\\1"), "\\[https?://\\S+\\]")
    e = s_sub(s_sub(e, "(?is)<ref[^>]*>.*?</ref>"), "<[^>]+>")
    e = s_sub(s_sub(e, "={2,6}\\s*(.*?)\\s*={2,6}", "\n\n\\1\n"), "'{2,3}")
    e = s_sub(s_replace(e, RAW_HTML), "&#\\d+;")
    return s_strip(s_sub(s_sub(s_sub(e, "\\r\\n?", "\n"), " {2,}", " "), "\\n{3,}", "\n\n"))


@C.add("F14_clean_wikitext", f"select pair_id, {_s_wikitext(_wiki('ing', 'source'))} as text from parallel_ing_rus where ing is not null and source is not null")
def f14(spark, d):
    return table(spark, d, "parallel_ing_rus").where("ing is not null and source is not null").select("pair_id", S.clean_wikitext(_wiki_col("ing", "source")).alias("text"))


_lines = f"list_filter(list_transform(string_split(t, chr(10)), lambda x: {s_strip('x')}), lambda x: x <> '' and not regexp_matches(x, '^=+\\s*.+\\s*=+$'))"


@C.add("F15_wiki_line", f"select mono_id, {s_strip(s_sub(f'array_to_string({_lines}, chr(32))', '[ \\t]+', ' '))} as text from (select mono_id, concat('== ', source, ' ==', chr(10), text) t from mono where text is not null)")
def f15(spark, d):
    t = F.concat(F.lit("== "), F.coalesce("source", F.lit("")), F.lit(" ==\n"), "text")
    return table(spark, d, "mono").where("text is not null").select("mono_id", S.wiki_line(t).alias("text"))


@C.add("F16_library_page", f"""
with h as (select doc_id, case doc_id % 3 when 0 then concat('<HTML><body><pre> ', text, '&nbsp;x</pre>tail') when 1 then concat('<html><style>a</style><b>', text, '</b>&gt;') else text end h from documents where text is not null)
select doc_id, {s_strip(s_sub(s_sub(s_replace("case when not regexp_matches(h, '(?i)<html') then h when regexp_matches(h, '(?is)<pre[^>]*>.*?</pre>') then regexp_extract(h, '(?is)<pre[^>]*>(.*?)</pre>', 1) else " + s_sub(s_sub(s_sub("h", "(?is)<script[^>]*>.*?</script>"), "(?is)<style[^>]*>.*?</style>"), "<[^>]+>") + " end", RAW_HTML), "\\r\\n?", chr(10)), "\\n{3,}", chr(10) * 2))} as text from h""")
def f16(spark, d):
    k = F.col("doc_id") % 3
    page = F.when(k == 0, F.concat(F.lit("<HTML><body><pre> "), "text", F.lit("&nbsp;x</pre>tail"))).when(k == 1, F.concat(F.lit("<html><style>a</style><b>"), "text", F.lit("</b>&gt;"))).otherwise(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", S.library_page(page).alias("text"))


@C.add("F17_between", f"""
with a as (select pair_id, case when strpos(rus, 'В селе') > 0 then substring(rus, strpos(rus, 'В селе')) else rus end c from parallel_ing_rus),
b as (select pair_id, c, strpos(c, ' на ') stop from a),
e as (select *, case when stop > 0 and strpos(substring(c, stop), '.') > 0 then stop - 1 + strpos(substring(c, stop), '.') else 0 end dot from b)
select pair_id, {s_strip("case when stop = 0 then c when dot > 0 then substring(c, 1, dot) else substring(c, 1, stop - 1) end")} as text from e""")
def f17(spark, d):
    return table(spark, d, "parallel_ing_rus").select("pair_id", S.between(F.col("rus"), "В селе", " на ").alias("text"))


over("F18_clean_first_side", "mono", "mono_id", "text", S.clean_first_side, s_strip(s_sub(s_sub(s_sub(s_sub("text", f"[-‐][{_W}\\n]*\\n[{_W}\\n]*"), "\\n", " "), f"[{_W}\\n]+", " "), "[`']([а-яА-ЯёЁ])", "\\1")))
over("F19_strip_punctuation", "parallel_ing_rus", "pair_id", "ing", S.strip_punctuation, s_sub("ing", "[^\\pLӏ]"))
_slug = f"lower({s_sub('substring(' + s_sub(s_strip(s_sub('title', f'[^\\pL\\pM\\pN_{_W}\\n-]')), f'[{_W}\\n_]+', '-') + ', 1, 80)', '^-+|-+$')})"


@C.add("F20_slug", f"select distinct slug, concat('book_', {_slug}) as value from book_catalog")
def f20(spark, d):
    return table(spark, d, "book_catalog").select("slug", S.slug(F.col("title"), "book").alias("value")).distinct()


_as = s_sub(s_sub(s_strip("lower(title)"), "[^\\pL\\pM\\pN_]+", "-"), "-+", "-")
_as = s_sub(s_sub(s_sub(_as, "^-|-$"), "[^a-z0-9-]"), "^-+|-+$")


@C.add("F21_ascii_slug", f"select distinct slug, concat('w-', case when {_as} = '' then substring(url_encode(lower(title)), 1, 40) else {_as} end) as value from book_catalog where title is not null")
def f21(spark, d):
    return table(spark, d, "book_catalog").where("title is not null").select("slug", S.ascii_slug(F.col("title"), "w").alias("value")).distinct()


@C.add("F22_path_slug", f"select distinct slug, list_extract(string_split({s_sub('download_page_url', '/+$')}, '/'), -1) as value from book_catalog")
def f22(spark, d):
    return table(spark, d, "book_catalog").select("slug", S.path_slug(F.col("download_page_url")).alias("value")).distinct()


@C.add("F23_mapped_source", f"select distinct slug, case category_name when 'Газеты' then 'press' when 'История' then 'history' else concat('src-', lower({s_sub(s_sub("coalesce(category_name, 'unknown')", '[^\\pL\\pM\\pN_]+', '-'), '^-+|-+$')})) end as value from book_catalog")
def f23(spark, d):
    return table(spark, d, "book_catalog").select("slug", S.mapped_source(F.col("category_name"), {"Газеты": "press", "История": "history"}, "src-").alias("value")).distinct()


_NAME = "[А-ЯЁ][а-яё]+\\s+[А-ЯЁ]\\.[А-ЯЁ]\\."


@C.add("F24_guess_author", f"""
with t as (select distinct slug, author, case when length(slug) % 2 = 0 then concat(string_split(author, ' ')[2], ' ', 'А.Б. — ', title) else concat(title, ' — ', string_split(author, ' ')[2], ' В.Г.') end t from book_catalog where author is not null)
select distinct slug, t, coalesce(nullif(regexp_extract(t, '^({_NAME})', 1), ''), nullif(regexp_extract(t, '[—–-]\\s*({_NAME})', 1), '')) as value from t""")
def f24(spark, d):
    surname = F.get(F.split("author", " "), F.lit(1))
    t = F.when(F.length("slug") % 2 == 0, F.concat(surname, F.lit(" А.Б. — "), "title")).otherwise(F.concat("title", F.lit(" — "), surname, F.lit(" В.Г.")))
    t = F.when(F.length("slug") % 2 == 0, F.concat(F.coalesce(surname, F.lit("")), F.lit(" А.Б. — "), F.coalesce("title", F.lit("")))).otherwise(F.concat(F.coalesce("title", F.lit("")), F.lit(" — "), F.coalesce(surname, F.lit("")), F.lit(" В.Г.")))
    return table(spark, d, "book_catalog").where("author is not null").select("slug", t.alias("t"), S.guess_author(t).alias("value")).distinct()


@C.add("F25_first_int", "select distinct slug, file_size, coalesce(try_cast(regexp_extract(file_size, '(\\d+)', 1) as bigint), 0) as value from book_catalog")
def f25(spark, d):
    return table(spark, d, "book_catalog").select("slug", "file_size", S.first_int(F.col("file_size")).alias("value")).distinct()


@C.add("F26_size_mb", f"select distinct slug, file_size, coalesce(try_cast(string_split({s_squeeze('file_size')}, ' ')[1] as double), 0) as value from book_catalog")
def f26(spark, d):
    return table(spark, d, "book_catalog").select("slug", "file_size", S.size_mb(F.col("file_size")).alias("value")).distinct()


@C.add("F27_genre", "select distinct slug, case when regexp_matches(t, '(?i)\\(поэзи') then 'poem' else 'prose' end as value from (select slug, case when priority = 1 then concat(title, ' (ПОЭЗИЯ)') else title end t from book_catalog)")
def f27(spark, d):
    t = F.when(F.col("priority") == 1, F.concat("title", F.lit(" (ПОЭЗИЯ)"))).otherwise(F.col("title"))
    return table(spark, d, "book_catalog").select("slug", S.genre(F.coalesce(t, F.lit(""))).alias("value")).distinct()


_hw = f"regexp_extract({s_strip('text')}, {lit(f'^([^{_W}\\n(,;—–]+)')}, 1)"
over("F28_headword", "documents", "doc_id", "text", S.headword, s_sub(s_sub(s_sub(_hw, "^[.,;:!?»«\"')0-9]+|[.,;:!?»«\"')0-9]+$"), "-+$"), "\\d+$"))
_bw = s_strip(s_sub(s_strip(s_sub(s_squeeze(s_replace(s_sub(s_strip("regexp_extract(h, '<b>([^<]+)</b>', 1)"), "<[^>]+>", " "), RAW_HTML)), "\\([^)]*\\)")), "[{}\\[\\]<>]"))
_bw = s_sub(s_sub(_bw, "[\\x{B9}\\x{B2}\\x{B3}\\x{2070}-\\x{2079}]"), "[\\x{300}-\\x{36F}]")
_bw = f"lower({s_strip(s_sub(s_strip(f'string_split_regex({_bw}, {lit('[,/]')})[1]'), '[^\\x{400}-\\x{4FF}' + _W + '\\n\\-]'))})"


@C.add("F28_bold_headword", f"select pair_id, case when length({_bw}) >= 2 then {_bw} end as value from (select pair_id, concat('<i>x</i><b> ', ing, ' (1)</b>') h from parallel_ing_rus where pair_type = 'word_pair')")
def f28b(spark, d):
    h = F.concat(F.lit("<i>x</i><b> "), F.coalesce("ing", F.lit("")), F.lit(" (1)</b>"))
    return table(spark, d, "parallel_ing_rus").where("pair_type = 'word_pair'").select("pair_id", S.bold_headword(h).alias("value"))


_st = s_strip(f"string_split({s_strip('rus')}, chr(10))[1]")
_st = f"replace({s_strip(s_sub(_st, f'[{_W}\\n]*\\([^)]{{0,15}}\\)[{_W}\\n]*$'))}, chr(173), '')"


@C.add("F29_short_translation", f"select pair_id, case when length(s) > 60 then {s_strip('case when strpos(substring(s, 1, 60), ' + lit(',') + ') > 0 then ' + s_sub('substring(s, 1, 60)', ',[^,]*$') + ' else substring(s, 1, 60) end')} else s end as value from (select pair_id, {_st} s from parallel_ing_rus)")
def f29(spark, d):
    return table(spark, d, "parallel_ing_rus").select("pair_id", S.short_translation(F.col("rus")).alias("value"))


_pt = s_strip(f"string_split({s_sub('rus', f'Букв\\.:?[{_W}\\n]*«[^»]+»\\.?[{_W}\\n]*')}, '.')[1]")
over("F29_phrase_translation", "parallel_ing_rus", "pair_id", "rus", S.phrase_translation, s_strip(s_sub(s_strip(s_sub(_pt, f"[{_W}\\n]*\\([^)]{{10,}}\\)")), "[.,]+$")))
_nt = s_strip(f"string_split_regex({_strip1.replace('text', 'rus')}, {lit('\\d+\\.')})[1]")
_nt = s_sub(s_sub(s_strip(s_sub(s_strip(s_sub(_nt, "\\([^)]*\\)")), "\\[.*?\\]")), f"[{_W}\\n]+", " "), "^[ .,;:]+|[ .,;:]+$")
over("F29_numbered_translation", "parallel_ing_rus", "pair_id", "rus", S.numbered_translation, f"case when length({_nt}) > 1 then {_nt} else '' end")


@C.add("F30_dash_entries", f"""
with l as (select doc_id, unnest(string_split(replace(text, '—', '–'), chr(10))) line, generate_subscripts(string_split(replace(text, '—', '–'), chr(10)), 1) pos from documents),
n as (select doc_id, pos, replace({s_strip('line')}, ' - ', ' – ') s, lead(line) over (partition by doc_id order by pos) nx from l),
e as (select *, strpos(s, ' – ') cut from n),
r as (select doc_id, pos, {s_strip("string_split(substring(s, 1, cut - 1), '//')[1]")} lft, case when length({s_strip('substring(s, cut + 3)')}) < 5 and nx is not null then concat(substring(s, cut + 3), ' ', {s_strip('nx')}) else substring(s, cut + 3) end rgt from e where cut > 0),
w as (select doc_id, pos, lower(regexp_extract(lft, '^([а-яёА-ЯЁӏIі][а-яёА-ЯЁӏIіъь\\-]*)', 1)) word, {s_sub(s_strip("string_split(" + s_strip("replace(rgt, chr(173), '')") + ", ';')[1]"), "[.,]+$")} translation from r)
select doc_id, pos - 1 as pos, word, translation from w where length(word) >= 2 and length(translation) >= 2""")
def f30(spark, d):
    from pyspark.sql import Window

    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("—"), F.lit("–")), "\n")).alias("pos", "line"))
    nxt = F.lead("line").over(Window.partitionBy("doc_id").orderBy("pos"))
    return lines.select("doc_id", F.col("pos").cast("bigint").alias("pos"), S.dash_entry(F.col("line"), nxt).alias("e")).where("e is not null").select("doc_id", "pos", "e.word", "e.translation")


@C.add("F31_split_sides")
def f31(spark, d):
    return table(spark, d, "mono").where("text is not null").select("mono_id", S.split_sides(F.col("text"), r"[ыщэ]|(?U)\b(?:это|как|без|от|во|с|и|но|для|при|на)\b").alias("s")).select("mono_id", "s.first", "s.second")


over("F32_ellipsis", "mono", "mono_id", "text", lambda c: S.ellipsis(c, 180), "case when length(text) > 180 then concat(substring(text, 1, 180), '…') else text end")
over("F33_society_stem", "common_words", "word", "word", S.society_stem, s_sub("word", "цы$|ы$|и$|овцы$|евцы$"))


@C.add("F34_replace_nth_word", """
with t as (select pair_id, regexp_extract_all(ing, '(\\s+|\\S+)', 1) p from parallel_ing_rus where ing is not null),
u as (select pair_id, unnest(p) x, generate_subscripts(p, 1) i from t),
n as (select *, sum(case when regexp_matches(x, '\\S') then 1 else 0 end) over (partition by pair_id order by i) - 1 k from u)
select pair_id, string_agg(case when regexp_matches(x, '\\S') and k = 2 then '[X]' else x end, '' order by i) as value from n group by pair_id""")
def f34(spark, d):
    return table(spark, d, "parallel_ing_rus").where("ing <> ''").select("pair_id", S.replace_nth_word(F.col("ing"), F.lit(2), F.lit("[X]")).alias("value"))


@C.add("F35_fix_literal", f"select pair_id, {s_sub(s_sub('concat(' + lit('[{\"a\": \"') + ', num, ' + lit('\" , }, ]') + ')', ',\\s*\\]', ']'), ',\\s*\\}', '}')} as value from parallel_ing_rus")
def f35(spark, d):
    t = F.concat(F.lit('[{"a": "'), F.coalesce(F.col("num").cast("string"), F.lit("")), F.lit('" , }, ]'))
    return table(spark, d, "parallel_ing_rus").select("pair_id", S.fix_literal(t).alias("value"))


_cap = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {s_strip('x')}), lambda x: x <> '')[1]"


@C.add("F36_caps_title", f"select mono_id, case when len(string_split({s_squeeze('l')}, ' ')) <= 8 and l = upper(l) and regexp_matches(l, '\\pL') then l end as title from (select mono_id, {_cap} l from mono)")
def f36(spark, d):
    return table(spark, d, "mono").select("mono_id", S.caps_title(F.col("text")).alias("title"))


_vh = "concat('<h1>x</h1><sup>', num, '</sup> ', rus, ' <sup>', num + 1, '</sup><b>', ing, '</b> <sup>7</sup> ')"
_tail = "substring(x, strpos(x, '</sup>') + 6)"


@C.add("F37_verses", f"""
with p as (select pair_id, unnest(string_split({_vh}, '<sup>')[2:]) x from parallel_ing_rus where pair_type = 'verse' and rus is not null and ing is not null)
select pair_id, cast(string_split(x, '</sup>')[1] as integer) as n, {s_squeeze(s_sub(_tail, '<[^>]+>'))} as text from p where {s_squeeze(s_sub(_tail, '<[^>]+>'))} <> ''""")
def f37(spark, d):
    t = table(spark, d, "parallel_ing_rus").where("pair_type = 'verse' and rus is not null and ing is not null")
    html = F.concat(F.lit("<h1>x</h1><sup>"), "num", F.lit("</sup> "), "rus", F.lit(" <sup>"), (F.col("num") + 1).cast("string"), F.lit("</sup><b>"), "ing", F.lit("</b> <sup>7</sup> "))
    return t.select("pair_id", F.explode(S.verses(html)).alias("v")).select("pair_id", "v.n", "v.text")


_lh = "concat('<a href=\"https://x.example/inh/material/', slug, '\">1</a> <a href=''/inh/material/', slug, '''>2</a><a href=\"/inh/material/', category_slug, '#top\">3</a><a href=\"/other/', slug, '\">')"


@C.add("F38_page_links", f"""
with h as (select distinct slug, {_lh} h from book_catalog),
u as (select slug, list_distinct(list_concat(regexp_extract_all(h, 'href=["''](https://x.example/inh/material/[^"''#?]+)["'']', 1), list_transform(regexp_extract_all(h, 'href=["''](/inh/material/[^"''#?]+)["'']', 1), lambda x: concat('https://x.example', x)))) l from h)
select distinct slug, unnest(l) as link from u""")
def f38(spark, d):
    html = F.concat(F.lit('<a href="https://x.example/inh/material/'), "slug", F.lit("\">1</a> <a href='/inh/material/"), "slug", F.lit("'>2</a><a href=\"/inh/material/"), F.coalesce("category_slug", F.lit("")), F.lit('#top">3</a><a href="/other/'), "slug", F.lit('">'))
    return table(spark, d, "book_catalog").select("slug", F.explode(S.page_links(html, "https://x.example", "/inh/material/")).alias("link")).distinct()


_dh = "case entry_id % 5 when 0 then concat('<a href=\"https://e.example/wp/download-manager-files/', slug, '.pdf\">') when 1 then concat('onclick=\"location.href=''https://e.example/d/?wpdmdl=', entry_id, '''\"') when 2 then concat('see https://e.example/download/', slug, '/?wpdmdl=', entry_id, ' now') when 3 then concat('?id=', entry_id, '&x') else 'nothing' end"


@C.add("F39_download_url", f"""
with h as (select entry_id, slug, {_dh} h, concat('https://e.example/', slug, '//') page from download_state),
u as (select entry_id, nullif(regexp_extract(h, '(https?://[^\\s"''<>]+/download-manager-files/[^\\s"''<>]+\\.(?:pdf|PDF))', 1), '') a, nullif(regexp_extract(h, 'location\\.href=''([^'']+\\?wpdmdl=\\d+)''', 1), '') b,
 nullif(regexp_extract(h, '(https?://[^\\s"''<>]+/download/[^\\s"''<>]+\\?wpdmdl=\\d+)', 1), '') c, concat(regexp_replace(page, '/+$', ''), '/?wpdmdl=') || nullif(regexp_extract(h, '[?&]id=(\\d+)', 1), '') e from h)
select entry_id, coalesce(a, b, c, e) as url, case when a is not null then 'direct_pdf' when coalesce(b, c, e) is not null then 'wpdmdl' else 'error' end as method from u""")
def f39(spark, d):
    k = F.col("entry_id") % 5
    html = (
        F.when(k == 0, F.concat(F.lit('<a href="https://e.example/wp/download-manager-files/'), "slug", F.lit('.pdf">')))
        .when(k == 1, F.concat(F.lit("onclick=\"location.href='https://e.example/d/?wpdmdl="), "entry_id", F.lit("'\"")))
        .when(k == 2, F.concat(F.lit("see https://e.example/download/"), "slug", F.lit("/?wpdmdl="), "entry_id", F.lit(" now")))
        .when(k == 3, F.concat(F.lit("?id="), "entry_id", F.lit("&x")))
        .otherwise("nothing")
    )
    return table(spark, d, "download_state").select("entry_id", S.download_url(html, F.concat(F.lit("https://e.example/"), "slug", F.lit("//"))).alias("u")).select("entry_id", "u.url", "u.method")


@C.add("F40_page_ranges", "select pair_id, unnest(list_distinct(list_concat([num, num + 2], range(num + 2, num + 6)))) as page from parallel_ing_rus where num is not null")
def f40(spark, d):
    n = F.col("num")
    spec = F.concat(n.cast("string"), F.lit(", "), (n + 2).cast("string"), F.lit(","), (n + 2).cast("string"), F.lit("-"), (n + 5).cast("string"))
    return table(spark, d, "parallel_ing_rus").where("num is not null").select("pair_id", F.explode(S.page_ranges(spec)).alias("page"))


@C.add("F41_clean_page", f"select mono_id, {s_strip('replace(' + s_sub('concat(mono_id, chr(10), text)', '^\\s*\\d+\\s*\\n') + ', chr(173), ' + lit('') + ')')} as text from mono where text is not null")
def f41(spark, d):
    return table(spark, d, "mono").where("text is not null").select("mono_id", S.clean_page(F.concat(F.col("mono_id").cast("string"), F.lit("\n"), "text")).alias("text"))


@C.add("F42_from_start_line", """
with l as (select doc_id, text, string_split(text, chr(10)) l from documents),
p as (select *, list_position(list_transform(l, lambda x: contains(lower(x), 'село') or length(x) > 100), true) cut from l)
select doc_id, case when cut > 0 then array_to_string(l[cut:], chr(10)) else text end as text from p""")
def f42(spark, d):
    return table(spark, d, "documents").select("doc_id", S.from_start_line(F.col("text"), "Село").alias("text"))


_BODY = "concat('***', chr(10), 'intro', chr(10), 'PART A  ', chr(10), rus, chr(10), 'PART B', chr(10), ing)"


def _s_section(start: str, end: str) -> str:
    return s_strip(f"regexp_extract({_BODY}, '(?s)(?:^|\\n){start}[ \\t]*\\n(.*?)(?:\\n{end}[ \\t]*(?:\\n|$)|$)', 1)")


@C.add("F43_sections", f"select pair_id, {_s_section('PART A', 'PART B')} as first, {_s_section('PART B', 'PART C')} as second from parallel_ing_rus where rus is not null and ing is not null")
def f43(spark, d):
    body = F.concat(F.lit("***\nintro\nPART A  \n"), F.col("rus"), F.lit("\nPART B\n"), F.col("ing"))
    return table(spark, d, "parallel_ing_rus").where("rus is not null and ing is not null").select("pair_id", S.section(body, "PART A", "PART B").alias("first"), S.section(body, "PART B", "PART C").alias("second"))


# ---- tokens and segments


@C.add("G01_positioned_words", """
with t as (select pair_id, string_split_regex(ing, '[ \\t\\n\\x0B\\f\\r]+') p from parallel_ing_rus)
select pair_id, position, word from (select pair_id, generate_subscripts(p, 1) - 1 as position, unnest(p) as word from t) where word <> ''""")
def g01(spark, d):
    return table(spark, d, "parallel_ing_rus").select("pair_id", F.explode(W.positioned_words(F.col("ing"))).alias("w")).select("pair_id", F.col("w.position").cast("bigint").alias("position"), "w.word")


_MW = "list_filter(list_transform(list_filter(regexp_extract_all(lower({0}), '([а-яёӏ][а-яёӏ\\-]*)', 1), lambda w: length(w) >= 2), lambda w: regexp_replace(w, '^-+|-+$', '', 'g')), lambda w: w <> '')"
C_MODEL_WORDS = _MW


@C.add("G02_model_words", f"select pair_id, unnest({_MW.format('ing')}) as word from parallel_ing_rus")
def g02(spark, d):
    return table(spark, d, "parallel_ing_rus").select("pair_id", F.explode(W.model_words(F.col("ing"))).alias("word"))


@C.add("G03_letter_words", "select mono_id, unnest(regexp_extract_all(text, '([а-яёӏА-ЯЁӀ]{2,})', 1)) as word from mono")
def g03(spark, d):
    return table(spark, d, "mono").select("mono_id", F.explode(W.letter_words(F.col("text"))).alias("word"))


_PAR = f"list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda p: {s_strip('p')}), lambda p: length(p) > 30)"


@C.add("G04_paragraphs", f"select doc_id, unnest({_PAR}) as paragraph from documents")
def g04(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(W.paragraphs(F.col("text"))).alias("paragraph"))


_LONG = f"list_transform(list_filter(string_split({s_sub('p', f'([.!?])[{_W}\\n]+', '\\1' + chr(1))}, chr(1)), lambda s: length(s) >= 30), lambda s: {{'t': s, 'g': ' '}})"


@C.add("G05_segments", f"""
with recursive paragraphs as (select doc_id, list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda p: {s_strip('p')}), lambda p: length(p) >= 30) l from documents where text is not null),
u as (select doc_id, flatten(list_transform(l, lambda p: case when length(p) > 2000 then {_LONG} else [{{'t': p, 'g': chr(10) || chr(10)}}] end)) l from paragraphs),
r as (select doc_id, l, 1 as i, cast([] as varchar[]) as done, '' as now from u
 union all
 select doc_id, l, i + 1, case when length(now) + length(l[i].t) < 2000 or now = '' then done else list_append(done, {s_strip('now')}) end,
  case when length(now) + length(l[i].t) < 2000 then (case when now = '' then l[i].t else concat(now, l[i].g, l[i].t) end) else l[i].t end from r where i <= len(l)),
f as (select doc_id, case when now = '' then done else list_append(done, {s_strip('now')}) end s from r where i = len(l) + 1)
select doc_id, generate_subscripts(s, 1) - 1 as n, unnest(s) as segment from f""")
def g05(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(W.segments(F.col("text"))).alias("n", "segment")).select("doc_id", F.col("n").cast("bigint").alias("n"), "segment")


_ENDS = "([^А-ЯA-Z\\d])[.!?…]+(\\s+[А-ЯA-ZЁ«\"“]|$)"
_SOFT = "regexp_replace(replace(text, chr(173), ''), '-\\n', '', 'g')"
_LN = f"list_filter(list_transform(string_split({_SOFT}, chr(10)), lambda x: {s_strip('x')}), lambda x: x <> '')"
_CAPS = "(x = upper(x) and regexp_matches(x, '\\pL'))"


def _cut(flow: str, keep: str) -> str:
    """Sentences of a text: terminators are replaced by a mark, then it is split at the marks."""
    return f"list_filter(list_transform(string_split({s_sub(flow, _ENDS, '\\1' + chr(1) + '\\2')}, chr(1)), lambda y: {s_strip('y')}), lambda y: length(y) {keep})"


def _numbered(cut: str) -> str:
    return f"select mono_id, generate_subscripts(l, 1) - 1 as n, unnest(l) as sentence from (select mono_id, {cut} as l from mono where text is not null)"


_short = f"array_to_string(list_filter({_LN}, lambda x: not (len(string_split_regex(x, '\\s+')) <= 2 and (regexp_matches(x, '^\\d+$') or {_CAPS}))), ' ')"
_noncaps = f"array_to_string(list_filter({_LN}, lambda x: not (len(string_split_regex(x, '\\s+')) <= 8 and {_CAPS})), ' ')"
_flat = s_strip(s_sub("text", f"[{_W}\\n]+", " "))
_kept = f"list_filter(list_transform(string_split({s_sub(_flat, '([.!?»])\\s+([А-ЯЁ«\\d"])', '\\1' + chr(1) + '\\2')}, chr(1)), lambda y: {s_strip('y')}), lambda y: length(y) >= 15)"
for _name, _fn, _sql in (
    ("G06_sentences_joined", W.sentences_joined, _numbered(_cut(_short, "> 10"))),
    ("G07_sentences_by_line", W.sentences_by_line, _numbered(f"flatten(list_transform({_LN}, lambda x: {_cut('x', '>= 15')}))")),
    ("G08_sentences_kept", W.sentences_kept, _numbered(_kept)),
    ("G09_sentences_caps", lambda c: W.sentences_joined(c, 10, "caps"), _numbered(_cut(_noncaps, "> 10"))),
    ("G10_numbered_sections", lambda c: F.transform(W.numbered_sections(F.concat(F.lit("1.\n"), c)), lambda x: x["body"]), None),
):
    C.add(_name, _sql)(lambda spark, d, fn=_fn: table(spark, d, "mono").select("mono_id", F.posexplode(fn(F.col("text"))).alias("n", "sentence")))


_BL = "list_filter(list_transform(string_split_regex(regexp_replace(text, '-\\n', '', 'g'), '\\n[ \\t]*\\n'), lambda b: " + s_strip(s_sub("b", "\\s+", " ")) + "), lambda b: b <> '')"


@C.add("G12_blocks", f"select mono_id, unnest({_BL}) as block from mono")
def g12(spark, d):
    return table(spark, d, "mono").select("mono_id", F.explode(W.blocks(F.col("text"))).alias("block"))


_SCORE = f"(case when len(regexp_extract_all(text, '([а-яёӏА-ЯЁӀ]{{2,}})', 1)) = 0 then 0.0 else len(list_filter(regexp_extract_all(text, '([а-яёӏА-ЯЁӀ]{{2,}})', 1), lambda w: regexp_matches(w, '(?i){P.MARKERS}'))) / cast(len(regexp_extract_all(text, '([а-яёӏА-ЯЁӀ]{{2,}})', 1)) as double) end)"
_CLASS = f"case when length(regexp_replace(text, '[^а-яёА-ЯЁ]', '', 'g')) / cast(greatest(length(text), 1) as double) < 0.3 then 'other' when {_SCORE} >= 0.25 then 'ing' when {_SCORE} >= 0.05 then 'mixed' else 'rus' end"
SCORE_SQL, CLASS_SQL = _SCORE, _CLASS
over("L01_language_score", "mono", "mono_id", "text", lambda c: F.round(W.language_score(c), 6), f"round({_SCORE}, 6)", "score")
over("L02_classify", "mono", "mono_id", "text", W.classify, f"case when text is not null then {_CLASS} end", "class")

QUERIES, SQL = C.queries, C.sql
