"""String functions as column expressions: palochkas, mark-up, slugs, titles, entries.

All run inside the JVM; each takes and gives a Column, null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import profile as P

_W = P.WS


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def strip(c: Column) -> Column:
    """Without white space at both ends, by Unicode."""
    return F.btrim(c, F.lit(P.WS_CHARS))


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, ends stripped."""
    return strip(sub(c, f"[{_W}\\n]+", " "))


def normalize_palochka(c: Column, digits: bool = True) -> Column:
    """Capital palochka, I after a small consonant, and 1 between a consonant and a letter (if ``digits``)."""
    c = sub(F.translate(c, "Ӏ", P.PALOCHKA), f"(?<=[{P.CONSONANTS}])I", P.PALOCHKA)
    return sub(c, f"(?<=[{P.CONSONANTS}])1(?=[а-яёӏ])", P.PALOCHKA) if digits else c


def normalize_palochka_scan(c: Column) -> Column:
    """Five rules in order for scanned text, capitals included."""
    k = P.CONSONANTS_BOTH
    c = F.translate(c, "Ӏ", P.PALOCHKA)
    c = sub(c, f"(?<=[{k}])I(?=[а-яёӏ{_W}\\n,.!?\\-]|$)", P.PALOCHKA)
    c = sub(c, f"(?<=[{k}])I(?=[А-ЯЁ])", P.PALOCHKA)
    c = sub(c, f"(?<=[{k}])1(?=[{P.VOWELS_BOTH}])", P.PALOCHKA)
    c = sub(c, f"(?<=[{k}])\\|", P.PALOCHKA)
    return sub(c, "(?<=[гкхГКХ])[I1l|](?=[аео])", P.PALOCHKA)


def normalize_palochka_loose(c: Column) -> Column:
    """As above for another scan; a plain г between a consonant and a vowel is rewritten too."""
    c = F.translate(c, "Ӏ", P.PALOCHKA)
    c = sub(c, f"(?iu)(?<=[{P.CONSONANTS}])г(?=[аеёиоуыьъяю])", P.PALOCHKA)
    c = sub(c, f"(?<=[{P.CONSONANTS}])1(?=[а-яёА-ЯЁ])", P.PALOCHKA)
    return sub(c, f"(?<=[{P.CONSONANTS}])I(?=[а-яёА-ЯЁ])", P.PALOCHKA)


def clean_scan(c: Column) -> Column:
    """Blanks, blank lines, broken words, foreign characters and single-letter lines."""
    c = sub(sub(c, f"[{_W}]+", " "), "\\n{3,}", "\n\n")
    c = sub(c, "-\\n(?=[а-яёӏА-ЯЁ])")
    c = sub(c, "[^\\x{400}-\\x{4FF}\\x20-\\x7E\\x{A0}\\n\\t]")
    return strip(sub(c, f"(?m)^[{_W}\\n]*[А-ЯЁа-яё][{_W}\\n]*$"))


def replace_all(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def fix_html(c: Column) -> Column:
    """Entities in their order, short tags to blanks, blanks collapsed; line breaks stay."""
    return strip(sub(sub(replace_all(c, P.ENTITIES), "<[^>]{1,30}>", " "), "[ \\t]+", " "))


def strip_html(c: Column) -> Column:
    """Tags before entities, all white space collapsed."""
    c = replace_all(sub(c, "<[^>]+>", " "), (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")))
    return squeeze(c)


def strip_html_paragraphs(c: Column) -> Column:
    """Known entities, other ones dropped, tags to blanks; at most one blank line."""
    c = replace_all(c, (("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&laquo;", "«"), ("&raquo;", "»"), ("&hellip;", "…")))
    c = sub(sub(sub(c, "&[a-zA-Z]+;"), "<[^>]+>", " "), "[ \\t]+", " ")
    return strip(sub(c, f"\\n[{_W}\\n]*\\n[{_W}\\n]*\\n+", "\n\n"))


def article(html: Column) -> Column:
    """(title, text): the first h1, and all paragraphs of more than 30 characters."""
    title = strip(sub(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>"))
    bare = sub(sub(html, "(?is)<script[^>]*>.*?</script>"), "(?is)<style[^>]*>.*?</style>")
    parts = F.transform(F.regexp_extract_all(bare, F.lit("(?is)<p[^>]*>(.*?)</p>"), 1), lambda p: sub(strip(sub(p, "<[^>]+>")), f"[{_W}\\n]+", " "))
    return F.struct(title.alias("title"), F.array_join(F.filter(parts, lambda p: F.length(p) > 30), "\n\n").alias("text"))


def tab_text(html: Column, tab: str, limit: int = 30000) -> Column:
    """Text from the element with this id on, ``limit`` characters of mark-up; null if there is none."""
    at = F.instr(html, f'id="{tab}"')
    chunk = F.substring(html, at, F.lit(limit))
    end = F.instr(chunk, ">")
    return F.when((at > 0) & (end > 0), strip_html_paragraphs(F.substring(chunk, end + 1, F.length(chunk))))


def clean_wikitext(c: Column) -> Column:
    """Wiki mark-up to text: inclusions, categories, nested templates (six levels), links, references, headings."""
    c = sub(sub(c, "(?is)<noinclude>.*?</noinclude>"), "(?is)<includeonly>.*?</includeonly>")
    c = sub(sub(c, "\\[\\[Категория:[^\\]]+\\]\\]"), "\\[\\[[a-z]{2,3}:[^\\]]+\\]\\]")
    for _ in range(6):
        c = sub(c, "\\{\\{[^{}]*\\}\\}")
    c = sub(sub(c, "\\[\\[[^\\]|]+\\|([^\\]]+)\\]\\]", "$1"), "\\[\\[([^\\]]+)\\]\\]", "$1")
    c = sub(sub(c, "\\[https?://\\S+\\s+([^\\]]+)\\]", "$1"), "\\[https?://\\S+\\]")
    c = sub(sub(c, "(?is)<ref[^>]*>.*?</ref>"), "<[^>]+>")
    c = sub(sub(c, "={2,6}\\s*(.*?)\\s*={2,6}", "\n\n$1\n"), "'{2,3}")
    c = sub(replace_all(c, (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))), "&#\\d+;")
    return strip(sub(sub(sub(c, "\\r\\n?", "\n"), " {2,}", " "), "\\n{3,}", "\n\n"))


def wiki_line(c: Column) -> Column:
    """Lines without headings, joined by blanks."""
    lines = F.transform(F.split(c, "\n"), strip)
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike("^=+\\s*.+\\s*=+$"))
    return strip(sub(F.array_join(kept, " "), "[ \\t]+", " "))


def library_page(c: Column) -> Column:
    """The pre-formatted body of a page, or its text."""
    bare = sub(sub(sub(c, "(?is)<script[^>]*>.*?</script>"), "(?is)<style[^>]*>.*?</style>"), "<[^>]+>")
    pre = F.regexp_extract(c, "(?is)<pre[^>]*>(.*?)</pre>", 1)
    body = F.when(~c.rlike("(?i)<html"), c).when(c.rlike("(?is)<pre[^>]*>.*?</pre>"), pre).otherwise(bare)
    body = replace_all(body, (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")))
    return strip(sub(sub(body, "\\r\\n?", "\n"), "\\n{3,}", "\n\n"))


def between(c: Column, start: str, end: str | None = None) -> Column:
    """From the start marker (if found) to the full stop after the end marker (if found)."""
    at = F.instr(c, start)
    c = F.when(at > 0, F.substring(c, at, F.length(c))).otherwise(c)
    if end:
        stop = F.instr(c, end)
        dot = F.call_function("locate", F.lit("."), c, stop)
        c = F.when(stop == 0, c).when(dot > 0, F.substring(c, F.lit(1), dot)).otherwise(F.substring(c, F.lit(1), stop - 1))
    return strip(c)


def clean_first_side(c: Column) -> Column:
    """Broken words joined, one line, accents before Cyrillic dropped."""
    c = sub(sub(c, f"[-‐][{_W}\\n]*\\n[{_W}\\n]*"), "\\n", " ")
    return strip(sub(sub(c, f"[{_W}\\n]+", " "), "[`'](?=[а-яА-ЯёЁ])"))


def strip_punctuation(c: Column) -> Column:
    return sub(c, "[^\\p{L}ӏ]")


def slug(c: Column, prefix: str = "") -> Column:
    """Words joined by hyphens, 80 characters, lower case."""
    s = sub(strip(sub(c, f"[^\\p{{L}}\\p{{M}}\\p{{N}}_{_W}\\n-]")), f"[{_W}\\n_]+", "-")
    s = F.lower(sub(F.substring(s, 1, 80), "^-+|-+$"))
    return F.concat(F.lit(f"{prefix}_"), s) if prefix else s


def ascii_slug(c: Column, prefix: str) -> Column:
    """Latin letters and digits only; the percent-encoded title (40 characters) where nothing is left."""
    s = sub(sub(strip(F.lower(c)), "[^\\p{L}\\p{M}\\p{N}_]+", "-"), "-+", "-")
    s = sub(sub(sub(s, "^-|-$"), "[^a-z0-9-]"), "^-+|-+$")
    quoted = F.replace(F.replace(F.url_encode(F.lower(c)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.concat(F.lit(f"{prefix}-"), F.when(s == "", F.substring(quoted, 1, 40)).otherwise(s))


def path_slug(url: Column) -> Column:
    return F.element_at(F.split(sub(url, "/+$"), "/"), -1)


def mapped_source(c: Column, known: dict[str, str], prefix: str) -> Column:
    """The known slug, else one made of the words."""
    made = F.lower(sub(sub(F.coalesce(c, F.lit("unknown")), "[^\\p{L}\\p{M}\\p{N}_]+", "-"), "^-+|-+$"))
    pairs = [x for k, v in known.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[c], F.concat(F.lit(prefix), made)) if pairs else F.concat(F.lit(prefix), made)


def guess_author(title: Column) -> Column:
    name = "[А-ЯЁ][а-яё]+\\s+[А-ЯЁ]\\.[А-ЯЁ]\\."
    first = F.regexp_extract(title, f"^({name})", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.regexp_extract(title, f"[—–-]\\s*({name})", 1), F.lit("")))


def first_int(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, "(\\d+)", 1).try_cast("bigint"), F.lit(0))


def size_mb(c: Column) -> Column:
    """The number before the unit, 0 where there is none."""
    return F.coalesce(F.element_at(F.split(squeeze(c), " "), 1).try_cast("double"), F.lit(0.0))


def genre(title: Column) -> Column:
    return F.when(title.rlike("(?iu)\\(поэзи"), "poem").otherwise("prose")


def headword(line: Column) -> Column:
    """First word of a line without marks and figures; empty where there is none."""
    w = F.regexp_extract(strip(line), f"^([^{_W}\\n(,;—–]+)", 1)
    w = sub(w, "^[.,;:!?»«\"')0-9]+|[.,;:!?»«\"')0-9]+$")
    return sub(sub(w, "-+$"), "\\d+$")


def bold_headword(html: Column) -> Column:
    """The bold word of an entry, without brackets, indices, accents and alternatives; null below two letters."""
    w = strip_html(strip(F.regexp_extract(html, "<b>([^<]+)</b>", 1)))
    w = strip(sub(strip(sub(w, "\\([^)]*\\)")), "[{}\\[\\]<>]"))
    w = sub(sub(w, "[\\x{B9}\\x{B2}\\x{B3}\\x{2070}-\\x{2079}]"), "[\\x{300}-\\x{36F}]")
    w = strip(F.element_at(F.split(w, "[,/]"), 1))
    w = F.lower(strip(sub(w, f"[^\\x{{400}}-\\x{{4FF}}{_W}\\n\\-]")))
    return F.when(F.length(w) >= 2, w)


def short_translation(c: Column, cap: int = 60) -> Column:
    """First line without a closing note; a longer one is cut at the last comma before ``cap``."""
    s = strip(F.element_at(F.split(strip(c), "\n"), 1))
    s = F.replace(strip(sub(s, f"[{_W}\\n]*\\([^)]{{0,15}}\\)[{_W}\\n]*$")), F.lit("\u00ad"), F.lit(""))
    head = F.substring(s, 1, cap)
    return F.when(F.length(s) > cap, strip(F.when(head.contains(","), sub(head, ",[^,]*$")).otherwise(head))).otherwise(s)


def phrase_translation(c: Column) -> Column:
    """Without the literal reading, first sentence, no long brackets."""
    s = sub(c, f"Букв\\.:?[{_W}\\n]*«[^»]+»\\.?[{_W}\\n]*")
    s = strip(F.element_at(F.split(s, "\\."), 1))
    s = strip(sub(s, f"[{_W}\\n]*\\([^)]{{10,}}\\)"))
    return strip(sub(s, "[.,]+$"))


def numbered_translation(c: Column) -> Column:
    """The first numbered sense, without brackets; empty below two characters."""
    s = strip(F.element_at(F.split(strip_html(c), "\\d+\\."), 1))
    s = strip(sub(strip(sub(s, "\\([^)]*\\)")), "\\[.*?\\]"))
    s = sub(sub(s, f"[{_W}\\n]+", " "), "^[ .,;:]+|[ .,;:]+$")
    return F.when(F.length(s) > 1, s).otherwise("")


def dash_entry(line: Column, following: Column) -> Column:
    """(word, translation) of 'word – translation'; a short right side takes the next line along."""
    s = F.replace(strip(line), F.lit(" - "), F.lit(" – "))
    at = F.instr(s, " – ")
    left = strip(F.element_at(F.split(F.substring(s, F.lit(1), at - 1), "//"), 1))
    right = F.substring(s, at + 3, F.length(s))
    right = F.when((F.length(strip(right)) < 5) & following.isNotNull(), F.concat(right, F.lit(" "), strip(following))).otherwise(right)
    word = F.lower(F.regexp_extract(left, "^([а-яёА-ЯЁӏIі][а-яёА-ЯЁӏIіъь\\-]*)", 1))
    meaning = sub(strip(F.element_at(F.split(strip(F.replace(right, F.lit("\u00ad"), F.lit(""))), ";"), 1)), "[.,]+$")
    return F.when((at > 0) & (F.length(word) >= 2) & (F.length(meaning) >= 2), F.struct(word.alias("word"), meaning.alias("translation")))


def split_sides(c: Column, markers: str) -> Column:
    """(first, second): sentences up to the first one with a marker of the second language, and the rest."""
    parts = F.split(strip(c), f"(?<=\\.)[{_W}\\n]+")
    at = F.array_position(F.transform(parts, lambda s: s.rlike(markers)), True)
    n = F.size(parts)
    first = F.when(at == 0, parts).when(at == 1, F.array().cast("array<string>")).otherwise(F.slice(parts, 1, F.greatest((at - 1).cast("int"), F.lit(1))))
    second = F.when(at == 0, F.array().cast("array<string>")).otherwise(F.slice(parts, F.greatest(at.cast("int"), F.lit(1)), n))
    return F.struct(strip(F.array_join(first, " ")).alias("first"), strip(F.array_join(second, " ")).alias("second"))


def ellipsis(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def society_stem(c: Column) -> Column:
    return sub(c, "цы$|ы$|и$|овцы$|евцы$")


def replace_nth_word(c: Column, n: Column, word: Column) -> Column:
    """The n-th word (from 0) replaced, white space kept."""
    parts = F.regexp_extract_all(c, F.lit("(\\s+|\\S+)"), 1)
    is_word = F.transform(parts, lambda x: F.when(x.rlike("\\S"), 1).otherwise(0))
    nth = F.transform(is_word, lambda x, i: F.when(x == 1, F.aggregate(F.slice(is_word, F.lit(1), i + 1), F.lit(0), lambda a, b: a + b) - 1).otherwise(-1))
    return F.array_join(F.transform(F.arrays_zip(parts.alias("p"), nth.alias("k")), lambda x: F.when(x["k"] == n, word).otherwise(x["p"])), "")


def fix_literal(c: Column) -> Column:
    """Commas before closing brackets dropped."""
    return sub(sub(c, ",\\s*\\]", "]"), ",\\s*\\}", "}")


def caps_title(c: Column) -> Column:
    """The first line that isn't blank, if it is in capitals and has at most 8 words."""
    line = F.get(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), F.lit(0))
    return F.when((F.size(F.split(squeeze(line), " ")) <= 8) & (line == F.upper(line)) & line.rlike("\\p{L}"), line)


def verses(html: Column) -> Column:
    """(number, text) of each verse marked by a raised number."""
    pairs = F.regexp_extract_all(html, F.lit("(?s)<sup>(\\d+)</sup>\\s*(.*?)(?=<sup>|\\z)"), 0)
    return F.filter(
        F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, "<sup>(\\d+)</sup>", 1).cast("int").alias("n"), squeeze(sub(sub(x, "^<sup>\\d+</sup>"), "<[^>]+>")).alias("text"))),
        lambda x: x["text"] != "",
    )


def page_links(html: Column, base: str, path: str) -> Column:
    """Absolute links under a path, each once, in order of absolute then relative ones."""
    tail = "[^\"'#?]+"
    whole = F.regexp_extract_all(html, F.lit(f"href=[\"']({base}{path}{tail})[\"']"), 1)
    local = F.transform(F.regexp_extract_all(html, F.lit(f"href=[\"']({path}{tail})[\"']"), 1), lambda x: F.concat(F.lit(base), x))
    return F.array_distinct(F.concat(whole, local))


def download_url(html: Column, page: Column) -> Column:
    """(url, method): a direct file, a button, a download link, or one made of the id; null and 'error' else."""
    def hit(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))

    direct = hit("(https?://[^\\s\"'<>]+/download-manager-files/[^\\s\"'<>]+\\.(?:pdf|PDF))")
    button = hit("location\\.href='([^']+\\?wpdmdl=\\d+)'")
    link = hit("(https?://[^\\s\"'<>]+/download/[^\\s\"'<>]+\\?wpdmdl=\\d+)")
    made = F.concat(sub(page, "/+$"), F.lit("/?wpdmdl="), hit("[?&]id=(\\d+)"))
    url = F.coalesce(direct, button, link, made)
    return F.struct(url.alias("url"), F.when(direct.isNotNull(), "direct_pdf").when(url.isNotNull(), "wpdmdl").otherwise("error").alias("method"))


def page_ranges(c: Column) -> Column:
    """'0,1,5-7' as an array of page numbers."""
    def one(p: Column) -> Column:
        ends = F.split(p, "-")
        return F.sequence(ends[0].cast("int"), F.coalesce(F.get(ends, F.lit(1)), ends[0]).cast("int"))

    return F.array_distinct(F.flatten(F.transform(F.filter(F.transform(F.split(c, ","), strip), lambda x: x != ""), one)))


def clean_page(c: Column) -> Column:
    """Without a leading page number and soft hyphens."""
    return strip(F.replace(sub(c, "^\\s*\\d+\\s*\\n"), F.lit("\u00ad"), F.lit("")))


def from_start_line(c: Column, keyword: str, long: int = 100) -> Column:
    """From the first line with the keyword or of more than ``long`` characters."""
    lines = F.split(c, "\n")
    at = F.array_position(F.transform(lines, lambda x: F.lower(x).contains(keyword.lower()) | (F.length(x) > long)), True)
    return F.when(at > 0, F.array_join(F.slice(lines, at.cast("int"), F.size(lines)), "\n")).otherwise(c)


def section(c: Column, start: str, end: str) -> Column:
    """What stands between two headings on lines of their own (blanks behind them are ignored)."""
    return strip(F.regexp_extract(c, f"(?s)(?:^|\\n){start}[ \\t]*\\n(.*?)(?:\\n{end}[ \\t]*(?:\\n|$)|$)", 1))
