"""Problem 10: statistics of each text that tell prose from lists, tables and junk.

The layout is measured line by line: for each delimiter how many lines have the same
number of cells and how far the cells' places agree, the period of the indents, and how
line lengths repeat (autocorrelation at lag 1).  Columns that stand under each other need
no numbers to be a table, also where a single blank is left between two long cells; an
entry that runs over a period of lines (of indents, or long and short lines in turn)
counts as one.  The wording is
measured by ratios of words, symbols, vowels, end punctuation and common words.  One
pass over the documents, no shuffle; the list of common words goes to the executors
and must be below a bound.  A text is a list or a table if most of its lines and most
of its characters are entries or rows, so a small table does not outweigh prose.

Defined results: null, empty and blank texts have no kind and get a row of zeros in
the statistics; very long texts are measured whole.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The common words are sent to the executors; a longer table is refused, not cut.
MAX_COMMON_WORDS = 200_000
DELIMITERS = ("|", "│", "\t", ";", ",", "  ")
VOWELS = frozenset("аеёиоуыэюяӏaeiouyáéíóúäöüаьъ") - {"ь", "ъ"}
#: Least share of rows in which the cells of a column begin or end at one place.
AGREED = 0.8
#: Least autocorrelation of indents, and of line lengths that alternate (negative).
PERIODIC, ALTERNATING = 0.8, -0.5
MAX_PERIOD = 12
_CUTS = {d: regex.compile(regex.escape(d)) for d in DELIMITERS}
_FIGURES = regex.compile(r"[-—–]+|[\d.,%:/ +-]+")
_GAP = regex.compile(r" {2,}")
_INSIDE = regex.compile(r"\S {2,}\S")
_BULLET = regex.compile(r"^\s*(?:[-•*–—·▪◦‣+]|\(?\d{1,4}[.)]|\p{L}[.)])\s+")
_CONTENTS = regex.compile(r"(?:\.{4,}|…{2,}|_{4,}|(?:\. ){4,})\s*\d+\s*$")
_PAIR = regex.compile(r"^[^.!?]{1,40}\s[—–:=-]\s[^.!?]{1,40}$")
_NAME = regex.compile(r"^\p{Lu}[\p{L}-]+(?:,? \p{Lu}\.\s?(?:\p{Lu}\.)?)[,;.]?$")
_BIBLIO = regex.compile(r"—\s*(?:19|20|18)\d\d\.?\s*—|\b\d+\s*с\.\s*$")
_TAG = regex.compile(r"<[^<>]{0,300}>|&[a-z#0-9]{2,8};")
_CODED = regex.compile(r"(?:%[0-9A-Fa-f]{2}){3,}|(?:\\x[0-9A-Fa-f]{2}){3,}|(?:=[0-9A-F]{2}){3,}|(?:\\u[0-9a-fA-F]{4}){3,}|(?:&#\d+;){3,}|\b(?:[0-9A-Fa-f]{2}[ :]){8,}")
_TOKEN = regex.compile(r"\S+")
_ALPHA = regex.compile(r"\p{L}+")
_DIGIT = regex.compile(r"[\p{Nd}²³¹⁰-⁹₀-₉①-⑨]+")
_ALPHABETIC = regex.compile("[а-ёӏa-z]+")
_VOWEL = regex.compile("[" + "".join(sorted(VOWELS)) + "]+")


def _size(pattern, text: str) -> int:
    return sum(map(len, pattern.findall(text)))


_END = ".!?…»\"”:;"


def cells_of(line: str, delimiter: str) -> list[str]:
    if delimiter == "  ":
        return _GAP.split(line.strip())
    s = line.strip().strip(delimiter) if delimiter in "|│" else line.rstrip("\n")
    return s.split(delimiter)


def agreement(lines: list[str], delimiter: str) -> float:
    """How far the places of the cells agree over rows of equally many cells: the share of rows in which a column begins, or ends, at its commonest place, as the mean of the columns after the first."""
    spans = []
    for x in lines:
        x = x.expandtabs()
        if delimiter == "\t":
            delimiter = "  "
        if delimiter == "  ":
            cuts = [m.span() for m in _GAP.finditer(x.rstrip()) if m.start()]
        else:
            cuts = [m.span() for m in _CUTS[delimiter].finditer(x)]
        spans.append(cuts)
    columns = min(map(len, spans), default=0)
    if not columns:
        return 0.0
    return sum(max(Counter(s[j][e] for s in spans).most_common(1)[0][1] for e in (0, 1)) for j in range(columns)) / (columns * len(spans))


def blank_columns(lines: list[str]) -> tuple[float, int, float]:
    """(share, columns, agreement) of a table laid out with blanks: places that are blank in the rows from top to bottom part its columns.

    Half of the rows must have more than one blank there, which words in running lines don't.
    """
    none = (0.0, 0, 0.0)
    lines = [x.rstrip().expandtabs() for x in lines]
    if len(lines) < 4 or 2 * sum(bool(_INSIDE.search(x)) for x in lines) < len(lines):
        return none
    blank = Counter(p for x in lines for p, c in enumerate(x) if c == " ")
    reached = Counter(map(len, lines))
    rivers, left = [], len(lines)
    for p in range(max(map(len, lines))):
        left -= reached[p]  # lines that go on at p
        if left < max(4, 0.5 * len(lines)):
            break
        if blank[p] + len(lines) - left >= 0.9 * len(lines) and blank[p] >= 0.5 * len(lines):
            if rivers and rivers[-1][1] == p:
                rivers[-1][1] = p + 1
            else:
                rivers.append([p, p + 1])
    rivers = [r for r in rivers if r[0] and sum(not x[: r[0]].isspace() for x in lines) >= 0.9 * len(lines)]
    rivers = [r for r in rivers if 2 * sum(x[r[1] - 2 : r[1]] == "  " or x[r[0] : r[0] + 2] == "  " for x in lines) >= len(lines)]
    if not rivers:
        return none
    cuts = [0, *(r[1] for r in rivers)]
    rows = [[x[a:b].strip() for a, b in zip(cuts, [*cuts[1:], len(x)])] for x in lines if all(not x[a:b].strip() for a, b in rivers) and len(x) > rivers[0][1]]
    if len(rows) < 4:
        return none
    cells = [c for r in rows for c in r]
    if sum(len(c.split()) for c in cells) > 3.2 * len(cells) or sum(map(bool, cells)) < 0.4 * len(cells):
        return none
    agreed = len(rows) / len(lines)
    size = sum(sum(map(len, r)) for r in rows)
    return min(agreed, size / sum(len(x.replace(" ", "")) for x in lines) if size else 0.0), len(cuts), agreed


def table_score(lines: list[str]) -> tuple[float, int, float]:
    """Best share (of lines, and of characters if that is less) of the table's rows over all delimiters, the number of columns, and how far their places agree."""
    best = (0.0, 0, 0.0)
    size = sum(map(len, lines))
    for d in DELIMITERS:
        rows, lengths = [], []
        for x in lines:
            if d in x:
                rows.append(cells_of(x, d))
                lengths.append(len(x))
        if len(rows) < 3 or len(rows) < 0.5 * len(lines):
            continue
        counts = Counter(map(len, rows))
        columns, _ = counts.most_common(1)[0]
        if columns < 2:
            continue
        same = [r for r in rows if len(r) == columns]
        cells = [c.strip() for r in same for c in r]
        words = sum(len(c.split()) for c in cells) / len(cells)
        filled = sum(1 for c in cells if c)
        if filled < 0.4 * len(cells):
            continue
        # rows of one delimiter need not stand under each other, but if they do it is a table
        agreed = agreement([x for x in lines if d in x and len(cells_of(x, d)) == columns], d)
        laid = agreed >= AGREED and len(same) >= 4 and d not in ";,"
        if words > 3.2 and not (laid and d in "|│"):
            continue
        numeric = sum(1 for c in cells if c and (c == "-" or _FIGURES.fullmatch(c))) / len(cells)
        if d == "," and columns < 3 and numeric < 0.2:
            continue
        if d == "  " and numeric < 0.15 and not laid:
            continue
        if columns == 2 and d in ";," and numeric < 0.3:
            continue
        share = min(len(same) / len(lines), sum(k for r, k in zip(rows, lengths) if len(r) == columns) / size)
        if share > best[0]:
            best = (share, columns, agreed)
    if best[0] < 0.5:
        best = max(best, blank_columns(lines))
    return best


def indent_period(lines: list[str]) -> tuple[int, float]:
    """(lines a period, autocorrelation at that lag) of the indents; (0, 0.0) if all are alike or nothing repeats three times."""
    indents = [len(y) - len(y.lstrip()) for y in (x.expandtabs() for x in lines)]
    n = len(indents)
    mean = sum(indents) / n if n else 0.0
    var = sum((x - mean) ** 2 for x in indents)
    if var == 0:
        return 0, 0.0
    best = (0, 0.0)
    for lag in range(2, min(MAX_PERIOD, n // 3) + 1):
        # of the pairs there are, so that a long period is not held lower
        corr = sum((a - mean) * (b - mean) for a, b in zip(indents, indents[lag:])) / var * n / (n - lag)
        if corr > best[1] + 1e-9:
            best = (lag, corr)
    return best


def autocorrelation(lengths: list[int]) -> float:
    """Of line lengths at lag 1; 1 for lines of one length."""
    n = len(lengths)
    if n < 3:
        return 0.0
    mean = sum(lengths) / n
    var = sum((x - mean) ** 2 for x in lengths)
    if var == 0:
        return 1.0
    return sum((a - mean) * (b - mean) for a, b in zip(lengths, lengths[1:])) / var


def entry(line: str, words: int) -> bool:
    """Whether a line is one short entry of a list."""
    s = line.strip()
    if s[-1].isdigit() and _CONTENTS.search(s) or words <= 3 and _NAME.match(s) or _BIBLIO.search(s):
        return True
    if words > 9:
        return False
    if _BULLET.match(s) and words <= 9:
        return not s[-1] in ".!?…" or words <= 5
    if _PAIR.match(s) and words <= 9:
        return True
    return words <= 3 and s[-1] not in ".!?…"


def unit_entries(lines: list[str], period: int) -> float:
    """Share (of lines, and of characters if that is less) of the lines in units of ``period`` lines that are one short entry of a list."""
    least = min(len(x) - len(x.lstrip()) for x in lines)
    first = next(i for i, x in enumerate(lines) if len(x) - len(x.lstrip()) == least)
    held, size = 0, 0
    for i in range(first, len(lines), period):
        unit = lines[i : i + period]
        joined = " ".join(x.strip() for x in unit)
        words = len(joined.split())
        # verse has signs at the ends of its lines
        bare = all(x.rstrip()[-1] not in ",.;:!?…" for x in unit)
        if entry(joined, words) or bare and words <= 9 and entry(unit[0], len(unit[0].split())):
            held += len(unit)
            size += sum(map(len, unit))
    return min(held / len(lines), size / sum(map(len, lines)))


class Stats:
    """All measures of one text."""

    __slots__ = ("n_words", "mean_word_len", "symbol_ratio", "digit_ratio", "end_punct_share", "common_share", "n_lines", "mean_line_len", "entry_share", "table_share", "columns", "column_agreement", "indent_share", "indent_period", "indent_corr", "length_corr", "vowel_ratio", "repeat_share", "long_share", "single_share", "markup_share", "kind")

    def __init__(self, text: str, common_words: frozenset[str]):
        lines = [x for x in text.splitlines() if x.strip()]
        tokens = _TOKEN.findall(text)
        n = sum(map(len, tokens))
        words = common.words(text)
        self.n_words = len(words)
        self.mean_word_len = sum(map(len, words)) / len(words) if words else 0.0
        letters, digits = _size(_ALPHA, text), _size(_DIGIT, text)
        self.symbol_ratio = (n - letters - digits) / n if n else 0.0
        self.digit_ratio = digits / n if n else 0.0
        self.n_lines = len(lines)
        self.mean_line_len = sum(map(len, lines)) / len(lines) if lines else 0.0
        self.end_punct_share = sum(x.rstrip()[-1] in _END for x in lines) / len(lines) if lines else 0.0
        self.common_share = sum(w in common_words for w in words) / len(words) if words else 0.0
        counts = [len(x.split()) for x in lines]
        entries = [len(x) for x, k in zip(lines, counts) if entry(x, k)]
        self.entry_share = min(len(entries) / len(lines), sum(entries) / sum(map(len, lines))) if lines else 0.0
        self.table_share, self.columns, self.column_agreement = table_score(lines) if len(lines) >= 3 else (0.0, 0, 0.0)
        self.indent_share = sum(bool(_BULLET.match(x)) or x[0] in " \t" for x in lines) / len(lines) if lines else 0.0
        self.indent_period, self.indent_corr = indent_period(lines) if len(lines) >= 6 and any(x[0] in " \t" for x in lines) else (0, 0.0)
        self.length_corr = autocorrelation([len(x) for x in lines])
        lower = text.lower()
        known, alphabetic = _size(_VOWEL, lower), _size(_ALPHABETIC, lower)
        self.vowel_ratio = known / alphabetic if alphabetic else 1.0
        if len(words) >= 12:
            grams = Counter(zip(words, words[1:], words[2:]))
            self.repeat_share = 1 - len(grams) / (len(words) - 2)
        else:
            self.repeat_share = 0.0
        self.long_share = sum(len(t) for t in tokens if len(t) > 28 and t.isascii()) / n if n else 0.0
        self.single_share = sum(len(t) == 1 for t in tokens) / len(tokens) if tokens else 0.0
        marked = _size(_TAG, text) if "<" in text or "&" in text else 0
        marked += sum(len(m.group()) for m in _CODED.finditer(text)) if digits or "%" in text else 0
        self.markup_share = marked / n if n else 0.0
        self.kind = self.decide(alphabetic, letters, lines)

    def decide(self, alphabetic: int, letters: int, lines: list[str]) -> str | None:
        if not lines:
            return None
        table = self.table_share >= 0.5 and self.columns >= 2
        if self.markup_share > 0.35 or self.long_share > 0.4 or self.repeat_share > 0.6:
            return "junk"
        if table and self.symbol_ratio < 0.6:
            return "table"
        if self.single_share > 0.6 or self.symbol_ratio > 0.45 and self.entry_share < 0.5:
            return "junk"
        if alphabetic >= 20 and self.vowel_ratio < 0.22 and alphabetic > 0.7 * letters:
            return "junk"
        if self.n_lines >= 3 and self.entry_share >= 0.5:
            return "list"
        if self.n_lines >= 6:
            period = self.indent_period if self.indent_corr >= PERIODIC else 2 if self.length_corr <= ALTERNATING else 0
            if period and unit_entries(lines, period) >= 0.5:
                return "list"
        return None


COLUMNS = "n_words long, mean_word_len double, symbol_ratio double, digit_ratio double, end_punct_share double, common_share double, n_lines long, mean_line_len double, entry_share double, table_share double, columns long, column_agreement double, indent_share double, indent_period long, indent_corr double, length_corr double, vowel_ratio double, repeat_share double, long_share double, single_share double, markup_share double, kind string"


def text_stats(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measures..., kind): one row per row of ``docs``; kind is null for prose and verse."""
    rows = common_words.select(F.lower("word").alias("w")).where("w is not null").distinct().limit(MAX_COMMON_WORDS + 1).collect()
    if len(rows) > MAX_COMMON_WORDS:
        raise ValueError(f"more than {MAX_COMMON_WORDS} common words")
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(w for r in rows for w in common.words(r.w)))
    names = Stats.__slots__
    types = [pa.int64() if c.split()[1] == "long" else pa.string() if c.split()[1] == "string" else pa.float64() for c in COLUMNS.split(", ")]

    def run(batches):
        for b in batches:
            made = [Stats(t or "", shared.value) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([getattr(s, c) for s in made], t) for c, t in zip(names, types))], names=[id_col, *names])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("__t")).mapInArrow(run, f"{id_col} bigint, {COLUMNS}")


def p10_stats(spark, sf_dir: str) -> DataFrame:
    return text_stats(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "common_words"))


def p10_found(spark, sf_dir: str) -> DataFrame:
    return p10_stats(spark, sf_dir).where("kind is not null").select("doc_id", "kind")
