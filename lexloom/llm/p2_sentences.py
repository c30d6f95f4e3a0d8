"""Problem 2: sentence boundaries across languages and scripts.

Spaced scripts: every run of terminators is a node of a lattice; an arc is a possible
sentence and its cost comes from the nodes it passes over and the one it ends in
(abbreviations, initials, figures, the letter that follows, open quotations, and for
years and lists how much of a sentence stands before).  The cheapest path gives the
sentences.  Blank lines and headings end a sentence in any case.

Spaceless script: the text is cut into words by the cheapest path through a lattice of
dictionary words (a unigram dictionary counted over the corpus itself), then every gap
between words is classified by its odds: how much more often than anywhere else the word
before it closes sentences (final particles, verb endings) and the word behind it opens
them, as counted at the marked ends of the whole corpus, and what a terminator in the gap
adds.  Inside quotations there are no gaps.

The dictionary that goes to the executors is a model with a bound: the ``HAN_WORDS`` most
frequent strings of up to four characters, and as many openers and as many finals.

Defined results: null, empty and blank texts have no sentence; text without any
terminator is one sentence; positions are counted in code points from 1 and the last
closing quote or mark belongs to its sentence.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: What ends sentences, what closes and opens quotations.
TERMINATORS = ".!?…؟۝۔。！？｡"
OPENING, CLOSING = "«„“‘「『(（[", "»”’」』)）]"
#: Abbreviations that stand before a name or figure and end no sentence.
TITLES = frozenset(("акад", "проф", "др", "д-р", "докт", "им", "св", "ред", "гр", "тов", "г-н", "г-жа", "инж", "ул", "пл", "пер", "обл", "р-н", "п", "гл", "ст", "рис", "табл", "с", "стр", "см", "ср", "напр", "т", "тт", "хь", "dr", "mr", "mrs", "ms", "prof", "st", "no", "vs", "fig", "gen", "col", "capt", "rev", "hon", "jr", "sr", "e.g", "i.e", "cf"))
#: Abbreviations of years and centuries, and the ones that close an enumeration.
YEARS = frozenset(("г", "гг", "ш", "в", "вв"))
ENDING = frozenset(("д", "п", "др", "пр", "etc"))
_ETC = regex.compile(r"(?:\bи\s+(?:кх|т)\.\s*[дп]\.|\bи\s+(?:др|пр)\.|\betc\.)$")
_RUN = regex.compile(rf"[{TERMINATORS}]+")
_BEFORE = regex.compile(r"[\w\-.]+$")
_YEAR = regex.compile(r"\d+\s*(?:[-–]\s*\d+\s*)?\w{1,2}$")
_HAN = regex.compile(r"[一-鿿㐀-䶿]")
_PARAGRAPH = regex.compile(r"\n[ \t\r\xa0]*(?:\n[ \t\r\xa0]*)+")
_WORDS = regex.compile(r"\w+")
_QUOTE = regex.compile(r"[«»„“”\"「」『』]")
_FOUR = regex.compile(r"\d{4}\b")
_DOTTED = regex.compile(r"(?:\w\.)+\w")
_FIRST_LINE = regex.compile(r"\s*([^\n]*\S)[^\S\n]*\n\s*(\S)")
FAR = 60.0
#: Bound of the spaceless dictionary; least count of what is evidence; most that one word tells (nats), and a terminator.
HAN_WORDS, HAN_MIN, HAN_MOST, HAN_MARK = 20_000, 3, 5.0, 14.0
FLUSH = 300_000


def _caseless(c: str) -> bool:
    return "Ა" <= c <= "Ჿ" or "Ⴀ" <= c <= "ჿ" or "؀" <= c <= "ۿ" or bool(_HAN.match(c))


def quoted(s: str) -> list[tuple[int, int]]:
    """Spans of closed quotations; a quote that is never closed in the paragraph opens none."""
    spans, stack, straight = [], [], None
    for m in _QUOTE.finditer(s):
        c, i = m.group(), m.start()
        if c == '"':
            before = s[i - 1] if i else " "
            after = s[i + 1] if i + 1 < len(s) else " "
            opens = (before.isspace() or before in "(«—–-") and not after.isspace()
            if straight is None:
                if opens or not i:
                    straight = i
            elif not opens or before in TERMINATORS:
                spans.append((straight, i))
                straight = None
            else:
                straight = i
        elif c in "«„「『" or c == "“" and (not stack or s[stack[-1]] != "„"):
            stack.append(i)
        elif stack:
            start = stack.pop()
            if not stack:
                spans.append((start, i))
    spans.sort()
    merged: list[tuple[int, int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


class Node:
    """A place where a sentence may end: its position and what ending or passing costs."""

    __slots__ = ("end", "stop", "skip", "opening")

    def __init__(self, end: int, stop: float, skip: float, opening: float = 0.0):
        #: ``opening`` is what ending costs if only a figure and its abbreviation stand before
        self.end, self.stop, self.skip, self.opening = end, stop, skip, opening


def nodes_of(s: str) -> list[Node]:
    spans = quoted(s)
    found, k, n = [], 0, len(s)
    last = -1
    for m in _RUN.finditer(s):
        a, b = m.start(), m.end()
        if a < last:
            continue
        while k < len(spans) and spans[k][1] < a:
            k += 1
        inside = k < len(spans) and spans[k][0] < a < spans[k][1]
        # closing marks right behind belong to the sentence
        e = b
        while e < n and (s[e] in CLOSING or s[e] == '"' and any(x[1] == e for x in spans[k : k + 1])):
            e += 1
        if e < n and e > b and s[e] in TERMINATORS:
            # the full stop that follows the closing quote ends it
            e2 = _RUN.match(s, e).end()
            while e2 < n and s[e2] in CLOSING:
                e2 += 1
            e, last = e2, e2
        closes = inside and e > spans[k][1]
        if inside and not closes:
            continue
        j = e
        while j < n and s[j].isspace():
            j += 1
        if j >= n:
            found.append(Node(e, 0.0, FAR))
            continue
        gap, c = j > e, s[j]
        mark = s[a:b]
        word = _BEFORE.search(s, max(0, a - 30), a)
        before = word.group() if word else ""
        if c in ",;:—–-)":
            continue  # the sentence goes on after a mark
        if closes:
            lower = c.islower() and not _caseless(c)
            found.append(Node(e, FAR if lower else 0.0, 0.0 if lower else 9.0))
            continue
        if mark == ".":
            if c.isdigit() and not gap and before[-1:].isdigit():
                continue
            low = before.lower()
            if not gap and c.isalnum():
                # run together: only a small letter or figure before and a capital or year behind
                if len(before) > 2 and "." not in before and before[-1].islower() and (c.isupper() or _FOUR.match(s, j, j + 5)):
                    found.append(Node(e, 0.0, 6.0))
                continue
            if len(before.rsplit(".", 1)[-1]) == 1 and before[-1:].isupper():
                continue  # an initial
            if c.islower() and not _caseless(c):
                continue
            if _ETC.search(s, max(0, a - 14), b):
                found.append(Node(e, 0.0, 7.0))
                continue
            if low in YEARS and _YEAR.search(s, max(0, a - 16), a):
                found.append(Node(e, 0.0, 6.0, 12.0))
                continue
            if low in TITLES or "." in low and low.rsplit(".", 1)[-1] in TITLES or "." in low and _DOTTED.fullmatch(low):
                continue
            if before.isdigit():
                found.append(Node(e, 0.0, 6.0, 12.0))
                continue
            found.append(Node(e, 0.0, 9.0))
            continue
        if c.islower() and not _caseless(c):
            continue
        if not gap and c.isalnum() and not _caseless(c) and mark[-1] not in "。！？｡۝؟" and not c.isupper():
            continue
        found.append(Node(e, 0.0, 9.0))
    return found


def cheapest(s: str, nodes: list[Node], start: int = 0) -> list[int]:
    """Ends of the sentences on the cheapest path through the nodes."""
    if not nodes:
        return []
    places = [start, *(x.end for x in nodes)]
    best, link = [0.0] + [1e18] * len(nodes), [0] * (len(nodes) + 1)
    for i in range(len(nodes)):
        if best[i] >= 1e18:
            continue
        passed = 0.0
        for j in range(i, len(nodes)):
            node = nodes[j]
            cost = node.stop
            if node.opening and len(_WORDS.findall(s, places[i], node.end)) <= 3:
                cost += node.opening
            total = best[i] + passed + cost
            if total < best[j + 1]:
                best[j + 1], link[j + 1] = total, i
            passed += node.skip
            if passed > FAR:
                break
    out, k = [], len(nodes)
    while k:
        out.append(places[k])
        k = link[k]
    return out[::-1]


class Han:
    """Words of a spaceless script, from a dictionary counted over the corpus, and the odds of the gaps between them."""

    def __init__(self, counts: dict[str, int], openers: dict[str, int], finals: dict[str, int], grams: dict[str, int] | None = None):
        """``counts`` are words; ``grams`` all strings, by which openers and finals are judged."""
        total = sum(counts.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1)
        self.unknown = math.log(total + 1) + 4
        grams = grams or counts
        places = sum(n for g, n in grams.items() if len(g) == 1) or 1
        self.opens, self.closes = (self.ratios(x, grams, places) for x in (openers, finals))
        ends = sum(n for g, n in finals.items() if len(g) == 1)
        self.prior = math.log((ends + 0.5) / places)

    @staticmethod
    def ratios(edge: dict[str, int], grams: dict[str, int], places: int) -> dict[str, float]:
        """Log of how much more often than anywhere a string stands at an edge of sentences."""
        edges = sum(n for g, n in edge.items() if len(g) == 1) or 1
        out = {}
        for g, n in grams.items():
            expected = n * edges / places
            value = math.log((edge.get(g, 0) + 0.5) / (expected + 0.5))
            out[g] = max(-HAN_MOST, min(HAN_MOST, value))
        return out

    def words(self, s: str) -> list[str]:
        """The cheapest path through the word lattice."""
        best, link = [0.0] + [1e18] * len(s), [0] * (len(s) + 1)
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + self.longest) + 1):
                cost = self.cost.get(s[i:j])
                if cost is None:
                    if j > i + 1:
                        continue
                    cost = self.unknown
                if best[i] + cost < best[j]:
                    best[j], link[j] = best[i] + cost, i
        out, k = [], len(s)
        while k:
            out.append(s[link[k] : k])
            k = link[k]
        return out[::-1]

    def odds(self, before: str, behind: str, marked: bool = False) -> float:
        """Log odds that a sentence ends between two words; an unknown word tells nothing."""
        return self.prior + self.closes.get(before, 0.0) + self.opens.get(behind, 0.0) + (HAN_MARK if marked else 0.0)

    def ends(self, s: str, marked: list[int]) -> tuple[set[int], set[int]]:
        """(ends of sentences in the unmarked gaps of ``s``, those of the ``marked`` places that are none)."""
        found: set[int] = set()
        words, places = [], []
        for m in _HAN_RUN.finditer(s):
            at = m.start()
            for w in self.words(m.group()):
                words.append(w)
                places.append((at, at + len(w)))
                at += len(w)
        refused = set()
        for k in range(len(words) - 1):
            a, b = places[k][1], places[k + 1][0]
            if a == b:
                if self.odds(words[k], words[k + 1]) > 0:
                    found.add(a)
                continue
            for e in marked:
                if a < e <= b and self.odds(words[k], words[k + 1], True) <= 0:
                    refused.add(e)
        return found, refused


_HAN_RUN = regex.compile(r"[一-鿿㐀-䶿]+")


def boundaries(text: str, han: Han | None = None) -> list[int]:
    """Position of the last character of every sentence, counted from 1."""
    out: list[int] = []
    start = 0
    cuts = [m.span() for m in _PARAGRAPH.finditer(text)] + [(len(text), len(text))]
    for a, b in cuts:
        part = text[start:a]
        if part.strip():
            ends = cheapest(part, nodes_of(part))
            # a heading on its own line: only the first line of a paragraph can be one
            opening = _FIRST_LINE.match(part)
            if opening:
                line, follows = opening.group(1), opening.group(2)
                capitals = line.upper() == line and any(c.isalpha() for c in line) and len(line) > 3
                if capitals and line[0].isupper() and line[-1] not in TERMINATORS + CLOSING + ',;:-—"' and len(line.split()) <= 8 and (follows.isupper() or follows in OPENING or follows.isdigit()):
                    ends.append(opening.end(1))
            if han is not None and _HAN.search(part):
                spans = quoted(part)
                found, refused = han.ends(part, ends)
                ends = [e for e in ends if e not in refused] + [e for e in found if not any(x < e <= y for x, y in spans)]
            size = len(part.rstrip())
            ends = sorted({e for e in ends if e < size and part[:e].strip()} | {size})
            out += [start + e for e in ends]
        start = b
    return out


def han_lexicon(df: DataFrame, text_col: str) -> tuple[dict, dict, dict, dict]:
    """Counts of the words of spaceless text, of openers, of finals, and of all strings of up to four characters.

    Counted over all rows; the HAN_WORDS most frequent of each kind are kept.
    """

    def run(batches):
        grams: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["g", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                for m in regex.finditer(r"[一-鿿]+", t):
                    s = m.group()
                    for k in (1, 2, 3, 4):
                        grams.update(["w" + s[i : i + k] for i in range(len(s) - k + 1)])
                for m in regex.finditer(rf"(?:^|[{TERMINATORS}”\n]\s*|“)([一-鿿]{{1,4}})", t):
                    grams.update(["o" + m.group(1)[:k] for k in range(1, len(m.group(1)) + 1)])
                for m in regex.finditer(rf"([一-鿿]{{1,4}})[{TERMINATORS}]", t):
                    grams.update(["f" + m.group(1)[-k:] for k in range(1, len(m.group(1)) + 1)])
                if len(grams) > FLUSH:
                    yield out()
                    grams.clear()
        yield out()

    sums = df.select(F.col(text_col).alias("t")).where(F.col("t").rlike("[一-鿿]")).mapInArrow(run, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= HAN_MIN)
    kind = Window.partitionBy(F.substring("g", 1, 1)).orderBy(F.desc("n"), "g")  # a limit for each of the three kinds, applied before the shuffle
    rows = sums.withColumn("k", F.row_number().over(kind)).where(F.col("k") <= HAN_WORDS).select("g", "n").collect()  # at most 3 x HAN_WORDS
    tables: dict[str, dict] = {"w": {}, "o": {}, "f": {}}
    for r in rows:
        tables[r.g[0]][r.g[1:]] = r.n
    grams = tables["w"]
    # a longer string is a word if it is far more frequent than its parts would make it
    single = sum(n for g, n in grams.items() if len(g) == 1) or 1
    kept = {}
    for g, n in grams.items():
        if len(g) == 1:
            kept[g] = n
        elif n / single > 4 * max((grams.get(g[:k], 1) / single) * (grams.get(g[k:], 1) / single) for k in range(1, len(g))):
            kept[g] = n
    return kept, tables["o"], tables["f"], grams


def segment(df: DataFrame, key_cols: list[str], text_col: str, lexicon=None) -> DataFrame:
    """(keys..., start_pos, end_pos): one row per sentence; ``lexicon`` is a broadcast of han_lexicon."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in key_cols) + ", start_pos int, end_pos int"

    def run(batches):
        han = None
        for b in batches:
            take, starts, ends = [], [], []
            for k, t in enumerate(b.column(len(key_cols)).to_pylist()):
                if not t or t.isspace():
                    continue
                if han is None and lexicon is not None and _HAN.search(t):
                    han = Han(*lexicon.value)
                at = 0
                for e in boundaries(t, han):
                    while t[at].isspace():
                        at += 1
                    take.append(k)
                    starts.append(at + 1)
                    ends.append(e)
                    at = e
            if take:
                index = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(index) for i in range(len(key_cols))), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[*key_cols, "start_pos", "end_pos"])

    return df.select(*key_cols, F.col(text_col).alias("__t")).mapInArrow(run, schema)


def _texts(spark, sf_dir):
    mono = common.read(spark, sf_dir, "mono").select(F.lit("mono").alias("table_name"), F.col("mono_id").alias("row_id"), F.col("text").alias("t"))
    par = common.read(spark, sf_dir, "parallel_ing_rus").select(F.lit("parallel_ing_rus").alias("table_name"), F.col("pair_id").alias("row_id"), F.col("ing").alias("t"))
    return mono, par


def p2_sentences(spark, sf_dir: str) -> DataFrame:
    """(table_name, row_id, start_pos, end_pos): the sentences of every record."""
    mono, par = _texts(spark, sf_dir)
    lex = spark.sparkContext.broadcast(han_lexicon(mono, "t"))
    return segment(mono, ["table_name", "row_id"], "t", lex).unionByName(segment(par, ["table_name", "row_id"], "t", lex))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """(table_name, row_id, end_pos) of the records of boundary_sample."""
    mono, par = _texts(spark, sf_dir)
    lex = spark.sparkContext.broadcast(han_lexicon(mono, "t"))
    sample = common.read(spark, sf_dir, "boundary_sample").select("table_name", "row_id").distinct()
    own = [df.join(sample.where(F.col("table_name") == name).select("row_id"), "row_id", "left_semi").select("table_name", "row_id", "t") for name, df in (("mono", mono), ("parallel_ing_rus", par))]
    return segment(own[0].unionByName(own[1]), ["table_name", "row_id"], "t", lex).select("table_name", "row_id", "end_pos")
