"""Problem 1: noise in text from scanned pages.

A page is read line by line.  Page furniture (page numbers, running heads) is told by
the shape of a line and its place between other lines, and words broken at line ends
are joined across it.  A word in which digits, signs or letters of another script stand
among its own letters is a suspect.  Its letters, each with what scanners read for it,
make a Levenshtein automaton that is intersected with a trie of the vocabulary words near it,
so every word that can win comes out; the candidates and the suspect as it stands are
ranked by edits, frequency and how often they stand beside the neighbouring words.  Only a
suspect that a vocabulary word beats is noise: a form that the corpus itself uses (a paper
size, a model number) stays.  Lines are then reflowed into paragraphs.

Every word of the corpus is vocabulary.  Suspects are distinct forms before they are looked
up, and a form meets only the words that are the same as it with letters left out, so the work
grows with forms and words and not with their product.  Neither goes to the driver or to every
executor; only ``PAIRS`` hashed counts of neighbours do.

Defined results: null, empty and blank texts have no noise; a heading that opens a
text, hard line breaks and the spellings of the palochka are none; a suspect that no
vocabulary word is near stays as it is and doesn't count; repeated rows count once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import p6_encoding as p6

PAIRS, FLUSH = 1 << 17, 300_000
#: Most words of a trie and forms of a task; letters from which forms are looked up by pieces.
SHARD, FORMS, LONG = 100_000, 50_000, 24
#: Cost of an edit and of leaving a misread sign, in tens; most that the word on either side can give.
EDIT, MISREAD, BESIDE = 5.0, 0.5, 1.0

#: What scanners read for a Cyrillic letter.
CONFUSED = {
    "a": "а", "b": "ьв", "c": "с", "d": "д", "e": "е", "g": "д", "h": "н", "k": "к", "m": "т", "n": "п", "o": "о", "p": "р", "r": "г", "t": "т", "u": "и", "x": "х", "y": "у",
    "A": "а", "B": "в", "C": "с", "E": "е", "H": "н", "K": "к", "M": "м", "O": "о", "P": "р", "T": "т", "X": "х", "Y": "у",
    "0": "о", "3": "з", "4": "ч", "6": "б", "8": "в", "9": "д",
    "rn": "м", "JI": "лд", "IO": "ю", "III": "ш", "}K": "ж", "I_": "ц", "JIJI": "л", "bI": "ы", "ll": "п",
}
NOISE_SIGNS = "^•_|}{~*"
_CYR = "а-яёА-ЯЁӏӀ"
_LETTER = regex.compile(rf"[{_CYR}]")
_OWN = regex.compile(r"[а-яёА-ЯЁ]")
#: One of another script, a digit or a sign next to a letter of the word; I, i and 1 may be palochkas.
_MISREAD = regex.compile(rf"(?<=[{_CYR}])[a-hj-zA-HJ-Z02-9]|[a-hj-zA-HJ-Z02-9](?=[{_CYR}])|(?<=[{_CYR}])[{regex.escape(NOISE_SIGNS)}]+(?=[{_CYR}I])|[}}]K(?=[{_CYR}])|I_(?=[{_CYR}])|III(?=[а-яё])|(?<=[а-яё])III|IO(?=[а-яё])|(?<=[а-яё])IO")
_SPACED = regex.compile(rf"(?<![{_CYR}\w])[{_CYR}](?: [{_CYR}]){{2,}}(?![{_CYR}\w])")
_HYPHEN = regex.compile(r"(?<=\p{L})[-­¬‐‑]$")
_CLEAN_WORD = regex.compile(rf"(?<![\w^•|}}])[{_CYR}I1][{_CYR}I1]+(?![\w^•|}}])")
#: Worth a closer look.
NEED = regex.compile(rf"\n|[{_CYR}][a-zA-Z02-9^•_|}}]|[a-zA-Z02-9}}_][{_CYR}]|III")

_NUMBER = r"\d{1,4}"
_FURNITURE = (
    regex.compile(rf"^\W*{_NUMBER}\W*$"),  # a page number, bare or between signs
    regex.compile(rf"^(?:стр|с|p|page)\.?\s*{_NUMBER}\.?$", regex.I),
    regex.compile(r"^[—–\-•*~\[(| ]*[ivxlc]{1,6}[—–\-•*~\])| ]*$", regex.I),
    regex.compile(rf"^.{{2,70}}\s*\|\s*{_NUMBER}$|^{_NUMBER}\s*\|\s*.{{2,70}}$"),
    regex.compile(rf"^\p{{L}}\.\s?\p{{L}}[\p{{L}}\p{{N}}]+\..{{2,60}}\s{_NUMBER}$"),  # author, title, page
    regex.compile(rf"^.{{2,70}}[^\s\d.,]\s{{3,}}{_NUMBER}$|^{_NUMBER}\s{{3,}}[^\s\d].{{2,70}}$"),
)
_AT_EDGE = regex.compile(rf"^{_NUMBER}\s|\s{_NUMBER}$")
_CAPITALS = regex.compile(r"^[\p{Lu}\p{N}\p{P}\p{Zs}ӀӏI1|+<>=]+$")


def fold(word: str) -> str:
    """Lower case, palochkas in one spelling."""
    w = word.lower()
    if "ӏ" not in w and ("1" in w or "i" in w):
        w = w.replace("1", "ӏ").replace("i", "ӏ")
    return w


def is_furniture(line: str) -> bool:
    """Whether a line between others is a page number or a running head, by its shape."""
    s = line.strip()
    if not s or len(s) > 90:
        return False
    if any(p.search(s) for p in _FURNITURE):
        return True
    letters = sum(c.isalpha() for c in s)
    if letters >= 3 and _CAPITALS.match(s):
        if _AT_EDGE.search(s):
            return True
        return len(s.split()) <= 6 and s[-1] not in ".!?…,:;»"
    return False


_UNITS = sorted((k for k in CONFUSED if len(k) > 1), key=len, reverse=True)


def units(form: str) -> list[list[str]]:
    """What a misread form may stand for: in each place the letters that are as good as one another.

    Signs of several letters may also be what they look like, so there are up to two readings.
    """

    def single(c: str) -> str:
        low = fold(c)
        return "".join(dict.fromkeys(low + CONFUSED.get(c, "") + CONFUSED.get(low, "")))

    joined, at = [], 0
    while at < len(form):
        u = next((u for u in _UNITS if form.startswith(u, at)), None)
        if u:
            joined.append(CONFUSED[u])
            at += len(u)
        else:
            if form[at] not in NOISE_SIGNS:
                joined.append(single(form[at]))
            at += 1
    apart = [single(c) for c in form if c not in NOISE_SIGNS]
    return [joined] if joined == apart else [joined, apart]


class Trie:
    """Words with their counts; nodes are dicts, a word's number stands under the key ""."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.count = words, counts
        self.root: dict = {}
        for i, w in enumerate(words):
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = i
        self.most = math.log10(max(counts, default=1))

    def within(self, form: list[str], k: int) -> list[tuple[int, int]]:
        """(number, distance) of all words at Levenshtein distance k or less from a reading.

        The automaton's state is a bit set of places in ``form`` for each number of
        errors; it walks down the trie and leaves a branch once the state is empty.
        """
        n = len(form)
        accept = 1 << n
        where: dict[str, int] = {}
        for i, letters in enumerate(form):
            for c in letters:
                where[c] = where.get(c, 0) | 1 << i
        start = [1]
        for _ in range(k):
            start.append(start[-1] | start[-1] << 1)
        full = (1 << n + 1) - 1
        found, stack = [], [(self.root, [s & full for s in start])]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    for e, s in enumerate(state):
                        if s & accept:
                            found.append((child, e))
                            break
                    continue
                hit = where.get(c, 0)
                now = [(state[0] & hit) << 1]
                for e in range(1, k + 1):
                    # match; insertion into or substitution in the word; deletion from it
                    now.append((((state[e] & hit) << 1) | state[e - 1] | state[e - 1] << 1 | now[e - 1] << 1) & full)
                if any(now):
                    stack.append((child, now))
        return found

    def candidates(self, form: str) -> list[tuple[str, float]]:
        """(word, cost) of every word within the distance that can be the cheapest, whatever stands beside it.

        Farther words are looked for only while one of them could still win.
        """
        best, found = math.inf, {}
        for reading in units(form):
            for k in range(3 if len(reading) > 5 else 2):
                if EDIT * k - self.most - 2 * BESIDE > best:
                    break
                for i, d in self.within(reading, k):
                    if d == k:
                        cost = EDIT * d - math.log10(self.count[i])
                        w = self.words[i]
                        found[w] = min(cost, found.get(w, math.inf))
                        best = min(best, cost)
        return [(w, c) for w, c in found.items() if c <= best + 2 * BESIDE]


def pair_bucket(a: str, b: str) -> int:
    return (zlib.crc32(a.encode()) * 31 + zlib.crc32(b.encode())) % PAIRS


def count_words(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(w, n) of all clean words, and (k, n) of hashed neighbours, counted over all rows."""

    def run(batches):
        words: Counter = Counter()
        pairs = np.zeros(PAIRS, dtype=np.int64)
        codes: dict[str, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64()), pa.nulls(len(words), pa.int32())], names=["w", "n", "k"])

        for b in batches:
            for t in b.column(0).to_pylist():
                own = [fold(w) for w in _CLEAN_WORD.findall(t)]
                words.update(own)
                if len(own) > 1:
                    code = []
                    for w in own:
                        c = codes.get(w)
                        if c is None:
                            if len(codes) > FLUSH:
                                codes.clear()
                            c = codes[w] = zlib.crc32(w.encode())
                        code.append(c)
                    a = np.asarray(code, dtype=np.int64)
                    np.add.at(pairs, (a[:-1] * 31 + a[1:]) % PAIRS, 1)
            if len(words) > FLUSH:
                yield out()
                words.clear()
        yield out()
        k = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.string()), pa.array(pairs[k], pa.int64()), pa.array(k, pa.int32())], names=["w", "n", "k"])

    return df.select(F.col(text_col).alias("t")).where("t is not null and t <> ''").mapInArrow(run, "w string, n bigint, k int")


def counts(*sources: tuple[DataFrame, str]) -> tuple[DataFrame, np.ndarray]:
    """(w, n) of all words of the corpus, and the hashed counts of neighbours."""
    both = None
    for df, col in sources:
        part = count_words(df, col)
        both = part if both is None else both.unionByName(part)
    # read by both jobs below, so the texts are counted once
    sums = common.checkpoint(both.groupBy("w", "k").agg(F.sum("n").alias("n")))
    pairs = np.zeros(PAIRS, dtype=np.int32)
    for r in sums.where("k is not null").select("k", "n").toLocalIterator():  # at most PAIRS numbers
        pairs[r.k] = min(r.n, 2**31 - 1)
    return sums.where("w is not null").select("w", "n"), pairs


class Reader:
    """Lays out one text after another."""

    def __init__(self, bits: np.ndarray | None = None):
        self.repairer = p6.Repairer(bits) if bits is not None else None

    @staticmethod
    def misread(token: str) -> tuple[int, int] | None:
        """Where the misread word stands in a token, if there is one."""
        if not _OWN.search(token) or not _MISREAD.search(token):
            return None
        for part in _PART.finditer(token):
            s = part.group()
            if _OWN.search(s) and _MISREAD.search(s):
                # figures glued to a word are figures: 1986шера, шера1986
                if _GLUED.fullmatch(s) and not _ONE_SIGN.fullmatch(s):
                    continue
                return part.start(), part.end()
        return None

    def lines(self, text: str) -> tuple[list[str], int, int]:
        """(lines without furniture and with broken words joined, words joined, lines of furniture)."""
        lines = text.split("\n")
        filled = [i for i, line in enumerate(lines) if line.strip()]
        joined = furniture = 0
        kept: list[str] = []
        for i, line in enumerate(lines):
            # not the opening line, and not alone
            if filled and i > filled[0] and len(filled) > 2 and is_furniture(line):
                furniture += 1
                continue
            kept.append(line.strip())
        # join what is broken; a blank line between is part of the page break
        flow: list[str] = []
        for line in kept:
            if flow and line and line[0].isalpha():
                k = len(flow) - 1
                while k > 0 and not flow[k]:
                    k -= 1
                if _HYPHEN.search(flow[k]) and line[0].islower() or flow[k][-1:] in "\u00ad¬" and flow[k][-1:]:
                    head, _, rest = line.partition(" ")
                    flow[k:] = [flow[k][:-1] + head, rest] if rest else [flow[k][:-1] + head]
                    joined += 1
                    continue
            flow.append(line)
        return flow, joined, furniture

    def read(self, text: str) -> tuple[str, int, int, list[tuple[int, int, str, str, str]]]:
        """(reflowed text, words joined, lines of furniture, suspects as (place, length, form, word before, word behind))."""
        if self.repairer is not None and p6.SUSPECT.search(text):
            text = self.repairer.repair(text)[0]
        flow, joined, furniture = self.lines(text)
        tokens: list[str] = []
        breaks: list[str] = []
        paragraph = opening = False
        for i, line in enumerate(flow):
            if not line:
                paragraph = bool(tokens)
                continue
            if _SPACED.search(line):
                line = _SPACED.sub(lambda m: m.group().replace(" ", ""), line)
            own = line.split()
            new = paragraph or opening
            opening = (not tokens or new) and _CAPITALS.match(line) and i + 1 < len(flow)
            paragraph = False
            breaks += ["\n\n" if new else " ", *[" "] * (len(own) - 1)]
            tokens += own
        suspects, at = [], 0
        for j, token in enumerate(tokens):
            at += len(breaks[j]) if j else 0
            span = self.misread(token)
            if span:
                beside = [fold(tokens[i].strip(_EDGES)) if 0 <= i < len(tokens) else "" for i in (j - 1, j + 1)]
                suspects.append((at + span[0], span[1] - span[0], token[span[0] : span[1]], *beside))
            at += len(token)
        whole = "".join(x for pair in zip(["", *breaks[1:]], tokens) for x in pair)
        return whole, joined, furniture, suspects


_PART = regex.compile(rf"[{_CYR}\w^•|}}{{~*]+")
_GLUED = regex.compile(rf"\d+[{_CYR}]+|[{_CYR}]+\d{{2,}}")
_ONE_SIGN = regex.compile(rf"[03468][{_CYR}]{{2,}}|[{_CYR}]+[03468]")
_EDGES = ".,!?:;«»\"()…—–-"
_SUSPECT = pa.struct([("at", pa.int32()), ("size", pa.int32()), ("form", pa.string()), ("before", pa.string()), ("behind", pa.string())])
PAGES = "row_id bigint, page bigint, text string, joined int, furniture int, suspects array<struct<at:int, size:int, form:string, before:string, behind:string>>"


def pages(df: DataFrame, id_col: str, text_col: str, bits=None, with_text: bool = True) -> DataFrame:
    """The rows that may be noisy, laid out (columns PAGES); ``bits`` is a broadcast of the encoding model."""

    def run(batches):
        reader = Reader(bits.value if bits is not None else None)
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and NEED.search(t):
                    text, joined, furniture, suspects = reader.read(t)
                    if joined or furniture or suspects:
                        rows.append((k, zlib.crc32(t.encode("utf-8", "replace")), text if with_text else None, joined, furniture, [dict(zip(("at", "size", "form", "before", "behind"), s)) for s in suspects]))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.list_(_SUSPECT))], names=["row_id", "page", "text", "joined", "furniture", "suspects"])

    return df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("__t")).mapInArrow(run, PAGES)


def _classes() -> dict[str, str]:
    """For each letter the one that stands for all letters that it may be mistaken for, at any remove."""
    of: dict[str, str] = {}
    for places in map(units, CONFUSED):
        for letters in (x for reading in places for x in reading):
            met = {of.get(c, c) for c in letters}
            least = max(met)  # a letter of the words' script, if there is one
            of |= dict.fromkeys(letters, least) | {c: least for c, x in of.items() if x in met}
    return of


_CLASS = _classes()


def skeleton(reading: list[str] | str) -> str:
    """A reading or a word with each letter's class; equal if the word is a reading's at distance 0."""
    return "".join([_CLASS.get(c := next((x for x in place if x >= "\u0400"), place[0]), c) for place in reading])


def shorter(s: str, k: int) -> set[str]:
    """The string with up to k letters left out."""
    found = last = {s}
    for _ in range(k):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        found = found | last
    return found


def _pieces(size: int, k: int) -> list[tuple[int, int]]:
    return [(size * i // (k + 1), size * (i + 1) // (k + 1)) for i in range(k + 1)]


def form_keys(form: str, k: int) -> set[int]:
    """Hashes of which a form shares one with every word at distance k or less from a reading of it.

    Strings at that distance are the same with up to k letters left out of each.  Of more than ``LONG``
    letters in k + 1 pieces one is whole in the other, at most k places away.
    """
    found: set[str] = set()
    for reading in units(form):
        if k == 2 and len(reading) <= 5:
            continue
        s, n = skeleton(reading), len(reading)
        found |= shorter(s, k) if n <= LONG or not k else {f"{n} {i} {s[a:b]}" for i, (a, b) in enumerate(_pieces(n, k))}
    return {zlib.crc32(x.encode("utf-8", "replace")) for x in found}


def word_keys(word: str, k: int) -> set[int]:
    """What ``form_keys`` is held against."""
    s, n = skeleton(word), len(word)
    found = shorter(s, k) if n <= LONG + k or not k else set()
    if k:
        for size in range(max(LONG + 1, n - k), n + k + 1):
            for i, (a, b) in enumerate(_pieces(size, k)):
                found |= {f"{size} {i} {s[a + d : b + d]}" for d in range(-k, k + 1) if a + d >= 0 and b + d <= n}
    return {zlib.crc32(x.encode("utf-8", "replace")) for x in found}


def _keyed(df: DataFrame, keys, k: int) -> DataFrame:
    """Each row (string, number) once for each of the keys of its string."""
    names = df.columns

    def run(batches):
        for b in batches:
            own = [keys(x, k) for x in b.column(0).to_pylist()]
            take = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]), pa.int64())
            flat = np.fromiter((y for x in own for y in x), np.int64, len(take))
            # in slices, as a batch of long words has hundreds of keys a row
            for at in range(0, len(take), FLUSH):
                part = take[at : at + FLUSH]
                yield pa.RecordBatch.from_arrays([pa.array(flat[at : at + FLUSH]), b.column(0).take(part), b.column(1).take(part)], names=["key", *names])

    return df.mapInArrow(run, f"key bigint, {', '.join(f'{c} {t}' for c, t in df.dtypes)}")


_OPTIONS = "array<struct<w:string, cost:double>>"


def retrieve(forms: DataFrame, vocabulary: DataFrame, shard: int = SHARD, block: int = FORMS) -> DataFrame:
    """(form, options): for each distinct form every vocabulary word that can win, with its cost.

    Words and forms meet on keys, first those at distance 0.  What is found bounds how rare a farther word may
    be, over the whole vocabulary, so few forms meet words at distance 1 and 2.  The automaton of a form is run
    over the trie of the words that it meets.
    """
    forms, words = forms.select("form"), vocabulary.select("w", F.col("n").cast("bigint").alias("n"))
    n, most = forms.count(), words.agg(F.max("n")).first()[0]
    spread = forms.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // block), min(2 * spread, -(-n // 500)))

    def run(batches):
        for b in batches:
            made = []
            for form, met in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = []
                for at in range(0, len(met), shard):
                    own = met[at : at + shard]
                    found += Trie([x["w"] for x in own], [x["n"] for x in own]).candidates(form)
                if found:
                    made.append((form, [{"w": w, "cost": c} for w, c in found]))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in made], pa.string()), pa.array([x for _, x in made], pa.list_(pa.struct([("w", pa.string()), ("cost", pa.float64())])))], names=["form", "options"])

    options = None
    for k in range(3):
        wanted = forms.withColumn("least", F.lit(0.0))
        if options is not None:
            # the count above which a word at distance k can still win
            best = options.groupBy("form").agg(F.min(F.array_min("options.cost")).alias("best"))
            bound = F.pow(F.lit(10.0), EDIT * k - 2 * BESIDE - F.col("best")) * (1 - 1e-9)
            wanted = forms.join(best, "form", "left").select("form", F.coalesce(bound, F.lit(0.0)).alias("least")).where(F.col("least") <= F.lit(most))
        rarest = wanted.agg(F.min("least")).first()[0] if most else None
        if rarest is None:
            continue
        pairs = _keyed(wanted, form_keys, k).join(_keyed(words.where(F.col("n") >= rarest), word_keys, k), "key").where("n >= least")
        met = pairs.select("form", "w", "n").repartition(parts, "form").groupBy("form").agg(F.collect_set(F.struct("w", "n")).alias("met"))
        found = common.checkpoint(met.mapInArrow(run, f"form string, options {_OPTIONS}"))
        options = found if options is None else options.unionByName(found)
    if options is None:
        return forms.where("false").withColumn("options", F.lit(None).cast(_OPTIONS))
    whole = options.groupBy("form").agg(F.array_distinct(F.flatten(F.collect_list("options"))).alias("options"))
    return whole.select("form", F.filter("options", lambda x: x["cost"] <= F.array_min("options.cost") + 2 * BESIDE).alias("options"))


def restored(form: str, word: str) -> str:
    """The vocabulary word with the capitals of the form."""
    letters = [c for c in form if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() or c == "ӏ" for c in letters):
        return word.upper()
    first = CONFUSED.get(form[0], form[0])
    return word[:1].upper() + word[1:] if form[0].isupper() or first[0].isupper() else word


def choose(form: str, seen: int, options: list[dict], before: str, behind: str, pairs: np.ndarray) -> str | None:
    """The word that was printed, or None if the form is rather meant as it stands."""

    def beside(w: str) -> float:
        return sum(min(BESIDE, math.log1p(pairs[pair_bucket(*p)]) / 6) for p in ((before, w), (w, behind)) if all(p))

    strange = sum(c in NOISE_SIGNS or c in CONFUSED for c in form)
    best = min(options, key=lambda o: (o["cost"] - beside(o["w"]), o["w"]))
    if best["cost"] - beside(best["w"]) + MISREAD * strange >= -math.log10(seen):
        return None
    return restored(form, best["w"])


def corrections(laid: DataFrame, vocabulary: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(table_name, row_id, page, at, size, word) of every suspect that a vocabulary word beats."""
    shared = laid.sparkSession.sparkContext.broadcast(pairs)
    found = laid.select("table_name", "row_id", "page", F.explode("suspects").alias("x")).select("table_name", "row_id", "page", "x.*")
    forms = common.checkpoint(found.groupBy("form").agg(F.count("*").alias("seen")))
    options = retrieve(forms, vocabulary).join(forms, "form")
    names = ["table_name", "row_id", "page", "at", "size"]

    def run(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5, 10)]
            made = [choose(*x, shared.value) for x in zip(*cols)]
            take = pa.array([i for i, w in enumerate(made) if w is not None], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(5)), pa.array([w for w in made if w is not None], pa.string())], names=[*names, "word"])

    return found.join(options, "form").select(*names, "form", "seen", "options", "before", "behind").mapInArrow(run, "table_name string, row_id bigint, page bigint, at int, size int, word string")


def _laid(spark, sf_dir: str, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """The laid-out pages of both tables, and the corrections of their words."""
    mono, par = common.read(spark, sf_dir, "mono"), common.read(spark, sf_dir, "parallel_ing_rus")
    vocabulary, pairs = counts((mono, "text"), (par, "ing"))
    bits = spark.sparkContext.broadcast(p6.model(p6.bigram_counts(mono, "text")))
    a = pages(mono, "mono_id", "text", bits, with_text).withColumn("table_name", F.lit("mono"))
    b = pages(par, "pair_id", "ing", None, with_text).withColumn("table_name", F.lit("parallel_ing_rus"))
    laid = common.checkpoint(a.unionByName(b))
    return laid, corrections(laid, vocabulary, pairs)


def p1_repaired(spark, sf_dir: str) -> DataFrame:
    """(table_name, row_id, text, joined, corrected, furniture) of every record with scan noise."""
    laid, fixes = _laid(spark, sf_dir, True)
    keys = ["table_name", "row_id", "page"]
    own = fixes.groupBy(*keys).agg(F.collect_list(F.struct("at", "size", "word")).alias("fixes"))
    rows = laid.drop("suspects").dropDuplicates(keys).join(own, keys, "left").where("joined > 0 or furniture > 0 or fixes is not null")

    def run(batches):
        for b in batches:
            texts, n = [], []
            for text, fixes in zip(b.column(2).to_pylist(), b.column(5).to_pylist()):
                made = {(f["at"], f["size"]): f["word"] for f in fixes or ()}
                parts, at = [], 0
                for (start, size), word in sorted(made.items()):
                    parts += [text[at:start], word]
                    at = start + size
                texts.append("".join(parts) + text[at:])
                n.append(len(made))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), b.column(3), pa.array(n, pa.int32()), b.column(4)], names=["table_name", "row_id", "text", "joined", "corrected", "furniture"])

    return rows.select("table_name", "row_id", "text", "joined", "furniture", "fixes").mapInArrow(run, "table_name string, row_id bigint, text string, joined int, corrected int, furniture int")


def p1_found(spark, sf_dir: str) -> DataFrame:
    """(table_name, row_id) of the records with page furniture, broken words, or words that a vocabulary word beats."""
    laid, fixes = _laid(spark, sf_dir, False)
    return laid.where("joined > 0 or furniture > 0").select("table_name", "row_id").unionByName(fixes.select("table_name", "row_id")).distinct()
