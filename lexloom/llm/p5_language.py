"""Problem 5: missing or wrong language labels.

A sparse multinomial logistic regression on TF-IDF weights of character n-grams (within
words, hashed to ``DIM`` columns) is trained online with follow-the-regularised-leader
and an elastic-net penalty, on a bounded sample of labelled rows: at most
``PER_LANGUAGE`` rows of each language, taken by the hash of their ids among those of at most
``TRAIN_CHARS`` characters.  Labels may be
wrong, so rows that a first model contradicts are left out of the next
training, twice; a held-out part then sets the temperature of the probabilities.

A vector is scaled by the root of its length, so the scores of a word are added up from a
cache.  A text whose words agree, without two of another language close together, is one
segment; in any other every sentence is classified and neighbouring sentences of one
language make a segment.  Garbled stretches are restored before and misread letters
replaced word by word; positions are those of the stored text.

Defined results: null and blank texts have no language; text without letters neither.
"""

from __future__ import annotations

import bisect
import math
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import p1_scan as p1
from . import p2_sentences as p2
from . import p6_encoding as p6

LANGUAGES = ("ing", "rus", "eng", "kat", "ara", "zho")
DIM, ORDERS = 1 << 17, (1, 2, 3, 4, 5)
PER_LANGUAGE, EPOCHS, TRAIN_CHARS = 600, 2, 4000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.1
#: The script of each language; a sentence in another script can't bear its label.
SCRIPTS = {lang: regex.compile(p) for lang, p in {"ing": r"\p{Cyrillic}", "rus": r"\p{Cyrillic}", "eng": r"\p{Latin}", "kat": r"\p{Georgian}", "ara": r"\p{Arabic}", "zho": r"\p{Han}"}.items()}
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}\p{N}]*")
#: A shorter sentence (names, a heading, a quoted phrase) brings no language of its own into a text.
MIN_WORDS, MIN_HAN = 3, 4
#: Most words of another likeliest language in a text that is taken as a whole.
FOREIGN = 0.15
#: Nats that a change of language costs between sentences: an unsure sentence follows its neighbours.
SWITCH = 1.5


def word_features(word: str) -> np.ndarray:
    """Hashed n-grams of a word with its edges."""
    s = f" {word} "
    if len(s) > 40 or "一" <= word[0] <= "鿿":
        s = s.strip()
    return np.asarray([zlib.crc32(s[i : i + n].encode()) % DIM for n in ORDERS for i in range(len(s) - n + 1)], dtype=np.int32)


_LOOKALIKES = {ord(k): v[0] for k, v in p1.CONFUSED.items() if len(k) == 1}
_MIXED = regex.compile(r"(?=.*\p{Cyrillic}).*[a-zA-Z0-9]")
#: A word broken at a line end.
_BROKEN = regex.compile(r"[-\u00ad¬‐‑]\s*\n\s*(?=\p{Ll})")


def folded(word: str) -> str:
    """Lower case, palochkas in one spelling, Cyrillic letters where others are mixed in."""
    if not _MIXED.match(word):
        return word.lower()
    w = p1.fold("".join("ӏ" if c in "1Ii" else c for c in word))
    return w.translate(_LOOKALIKES)


def words_of(text: str) -> list[str]:
    """Words as they stand, those broken at a line end joined."""
    return _WORD.findall(_BROKEN.sub("", text) if "\n" in text else text)


class Model:
    """Weights (languages × columns, already times idf), the temperature, and the mean number of n-grams of a sentence."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float, size: float = 100.0):
        self.weights, self.bias, self.temperature, self.size = weights, bias, temperature, size
        self.forget()

    def forget(self) -> None:
        self.kept: dict[str, int] = {}
        self.sums = np.zeros((1024, len(LANGUAGES)))
        self.sizes: list[int] = []
        self.best: list[int] = []

    def __getstate__(self):
        return self.weights, self.bias, self.temperature, self.size

    def __setstate__(self, state):
        self.__init__(*state)

    def scored(self, words: list[str]) -> list[int]:
        """The numbers of the words in ``sums`` (of weights), ``sizes`` (n-grams) and ``best`` (likeliest language)."""
        kept = self.kept
        out = []
        for w in words:
            i = kept.get(w)
            if i is None:
                f = word_features(folded(w))
                i = kept[w] = len(self.sizes)
                if i == len(self.sums):
                    self.sums = np.concatenate((self.sums, np.zeros_like(self.sums)))
                self.sums[i] = self.weights[:, f].sum(axis=1)
                self.sizes.append(len(f))
                self.best.append(int(self.sums[i].argmax()))
            out.append(i)
        return out

    def softmax(self, known: list[int], most: float = math.inf) -> np.ndarray:
        """Calibrated probabilities of scored words, as of a sentence of at most ``most`` n-grams."""
        n = sum([self.sizes[i] for i in known]) or 1
        return softmax((self.sums[known].sum(axis=0) / n * math.sqrt(min(n, most)) + self.bias) / self.temperature)

    def probabilities(self, words: list[str]) -> np.ndarray:
        return self.softmax(self.scored(words))

    def confidence(self, known: list[int], language: int) -> float:
        """Calibrated probability of a stretch's language, as of a sentence with its mix of words."""
        return float(self.softmax(known, self.size)[language])


def features(samples: list[tuple[list[str], int, int]]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(columns, counts, size) of each sentence; each word is hashed once."""
    kept: dict[str, np.ndarray] = {}
    out = []
    for words, _, _ in samples:
        parts = []
        for w in words:
            f = kept.get(w)
            if f is None:
                f = kept[w] = word_features(folded(w))
            parts.append(f)
        whole = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1])))
        out.append((whole[first], np.diff(np.append(first, len(whole))), float(len(whole))))
    return out


def train(samples: list[tuple[tuple, int]], rounds: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net over (features, language); (weights × idf, bias)."""
    df = np.zeros(DIM)
    rows = [(idx, tf, y, size) for (idx, tf, size), y in samples]
    for idx, _, _, _ in rows:
        df[idx] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    c = len(LANGUAGES)
    # a column's languages lie together
    z, n = np.zeros((DIM, c)), np.zeros((DIM, c))
    zb, nb = np.zeros(c), np.zeros(c)
    rng = np.random.default_rng(seed)

    def solve(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(rounds):
        for k in rng.permutation(len(rows)):
            idx, tf, y, size = rows[k]
            x = tf * idf[idx] / math.sqrt(size)
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w, b = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2)), solve(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            ni += g * g
            z[idx] = zi + g - (np.sqrt(ni) - root) / ALPHA * w
            n[idx] = ni
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA * b
            nb += p * p
    return (solve(z, n, L1).T * idf).astype(np.float32), solve(zb, nb, 0.0)


def temperature(model: Model, held: list[tuple[list[str], int]]) -> float:
    """The temperature with the least loss on held-out sentences, by golden section."""
    if not held:
        return 1.0
    p = np.array([model.probabilities(w) for w, _ in held])
    logits, y = np.log(np.maximum(p, 1e-300)), np.array([y for _, y in held])

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    a, b, g = 0.5, 5.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        if loss(c) < loss(d):
            b = d
        else:
            a = c
    return (a + b) / 2


def fit(samples: list[tuple[list[str], int, int]]) -> Model:
    """Train, leave out what is surely labelled wrongly, train again, calibrate.

    A sample is (words, language, row).  Wrong labels hold for whole rows, so a row that the
    model of the other half contradicts goes as a whole, and a single sentence too.
    """
    samples = [x for x in samples if x[0]]
    if not samples:
        raise ValueError("no labelled text to learn from")
    made = features(samples)
    half = [zlib.crc32(str(row).encode()) & 1 for _, _, row in samples]
    every = range(len(samples))
    kept = agreed = every
    for _ in range(2):
        scores: list = [None] * len(samples)
        for side in (0, 1):
            own = [i for i in kept if half[i] == side] or kept
            weights, bias = train([(made[i], samples[i][1]) for i in own], 1)
            for i in every:
                if half[i] != side:
                    idx, tf, size = made[i]
                    scores[i] = np.log(np.maximum(softmax(weights[:, idx] @ tf / math.sqrt(size) + bias), 1e-9))
        rows: dict = {}
        for (_, _, row), score in zip(samples, scores):
            rows[row] = rows.get(row, 0.0) + score
        agreed = [i for i in every if rows[samples[i][2]].argmax() == samples[i][1]] or every
        kept = [i for i in agreed if scores[i].argmax() == samples[i][1]] or every

    def held_out(i) -> bool:
        return zlib.crc32(str(samples[i][2]).encode()) % 7 == 3

    train_on = [i for i in kept if not held_out(i)]
    # hard sentences stay in the part that sets the temperature
    held = [samples[i][:2] for i in agreed if held_out(i)]
    weights, bias = train([(made[i], samples[i][1]) for i in train_on or kept], EPOCHS)
    model = Model(weights, bias, 1.0, float(np.mean([size for _, _, size in made])))
    model.temperature = temperature(model, held)
    model.forget()
    return model


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def sample(rows: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[list[str], int, int]]:
    """Sentences of at most PER_LANGUAGE rows of each language, chosen by the hash of the id."""
    label = F.lower(F.trim(F.col(lang_col)))
    labelled = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), label.alias("l")).where(F.col("l").isin(*LANGUAGES) & (F.length("t") <= TRAIN_CHARS))
    counts = {r.l: r.n for r in labelled.groupBy("l").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("l") == lang) & (F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, PER_LANGUAGE / n))))
    chosen = labelled.where(keep).select("i", "t", "l").collect()  # about PER_LANGUAGE rows of each language
    out, had = [], dict.fromkeys(LANGUAGES, 0)
    for r in sorted(chosen, key=lambda r: zlib.crc32(str(r.i).encode())):
        had[r.l] += 1
        if had[r.l] > 2 * PER_LANGUAGE or p6.SUSPECT.search(r.t) and regex.search(r"[\u0080-\u009fЂ-Џђ-џ─-◿�]", r.t):
            continue
        at = 0
        for e in p2.boundaries(r.t):
            own, lettered = words_of(r.t[at:e]), sum(map(str.isalpha, r.t[at:e]))
            fits = len(SCRIPTS[r.l].findall(r.t[at:e])) > 0.6 * lettered
            at = e
            if fits and (len(own) >= MIN_WORDS or own and "一" <= own[0][0] <= "鿿"):
                out.append((own, LANGUAGES.index(r.l), r.i))
    return out


class Labeller:
    """Restores a text, splits it where it may be mixed, and names the language of each stretch."""

    def __init__(self, model: Model, bits: np.ndarray | None):
        self.model = model
        self.repairer = p6.Repairer(bits) if bits is not None else None

    def sentences(self, text: str) -> list[tuple[int, int, int, list]]:
        """(start, end, words, their scores), positions from 1."""
        out, at = [], 0
        for e in p2.boundaries(text):
            words = words_of(text[at:e])
            while text[at].isspace():
                at += 1
            if words:
                n = sum(len(w) for w in words if "一" <= w[0] <= "鿿")
                out.append((at + 1, e, max(len(words), MIN_WORDS if n >= MIN_HAN else 0), self.model.scored(words)))
            at = e
        return out

    def one_language(self, text: str) -> tuple[int, list] | None:
        """(language, scores) of a text whose words agree; no two of another language stand within three longer words."""
        words = words_of(text)
        known = self.model.scored(words)
        if len(known) < MIN_WORDS:
            return None
        # words of one or two letters are alike in two languages
        best = [self.model.best[k] for w, k in zip(words, known) if len(w) > 2]
        if not best:
            return None
        top = max(set(best), key=best.count)
        other = [i for i, x in enumerate(best) if x != top]
        long = [w for w in words if len(w) > 2] if other else words
        # a spaceless sentence is one word
        if len(other) > FOREIGN * len(best) or any(b - a <= 2 for a, b in zip(other, other[1:])) or any(len(long[i]) >= MIN_HAN and "一" <= long[i][0] <= "鿿" for i in other):
            return None
        return top, known

    @staticmethod
    def path(probabilities: list[np.ndarray]) -> list[int]:
        """The likeliest languages of a row of sentences when a change costs SWITCH."""
        score, links = np.zeros(len(LANGUAGES)), []
        for k, p in enumerate(probabilities):
            if k:
                best = int(score.argmax())
                jump = score[best] - SWITCH
                links.append(np.where(score >= jump, np.arange(len(score)), best))
                score = np.maximum(score, jump)
            score = score + np.log(np.maximum(p, 1e-12))
        out = [int(score.argmax())] if probabilities else []
        for link in reversed(links):
            out.append(int(link[out[-1]]))
        return out[::-1]

    def segments(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, language, confidence) of the stretches of one language, positions in the stored text from 1."""
        if not text or text.isspace():
            return []
        if len(self.model.kept) > 100_000:
            self.model.forget()
        stored = text
        if self.repairer is not None and p6.SUSPECT.search(text):
            text = self.repairer.repair(text)[0]
        out = self.stretches(text)
        if text is not stored:
            place = places(stored, text)
            out = [(place(a - 1) + 1, place(b - 1, True) + 1, lang, p) for a, b, lang, p in out]
        return out

    def stretches(self, text: str) -> list[tuple[int, int, str, float]]:
        one = self.one_language(text)
        if one:
            return [(len(text) - len(text.lstrip()) + 1, len(text.rstrip()), LANGUAGES[one[0]], self.model.confidence(one[1], one[0]))]
        found = self.sentences(text)
        whole = [s for s in found if s[2] >= MIN_WORDS] or found
        langs = iter(self.path([self.model.softmax(s[3]) for s in whole]))
        out: list[list] = []
        for s in found:
            if s[2] < MIN_WORDS and whole is not found:
                # too short for a language of its own: goes with its neighbour
                if out:
                    out[-1][1] = s[1]
                continue
            lang = next(langs)
            if out and out[-1][2] == lang:
                out[-1][1] = s[1]
                out[-1][3] += s[3]
            else:
                out.append([s[0], s[1], lang, list(s[3])])
        return [(a, b, LANGUAGES[k], self.model.confidence(known, k)) for a, b, k, known in out]


def places(stored: str, restored: str):
    """A function from places of the restored text to places of the stored one; restoring keeps the blanks."""
    old, new = (regex.split(r"([ \n\r\t]+)", t) for t in (stored, restored))
    starts_old, starts_new = [0], [0]
    for a, b in zip(old, new):
        starts_old.append(starts_old[-1] + len(a))
        starts_new.append(starts_new[-1] + len(b))

    def place(i: int, last: bool = False) -> int:
        k = bisect.bisect_right(starts_new, i) - 1
        if k >= len(old):
            return len(stored) - 1
        if old[k] == new[k]:
            return starts_old[k] + i - starts_new[k]
        return starts_old[k] + (len(old[k]) - 1 if last else 0)

    return place


def label(rows: DataFrame, id_col: str, text_col: str, model: Model, bits=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., start_pos, end_pos, found, confidence): one row per segment, positions in the stored text."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((model, bits))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"{id_col} bigint, " + "".join(f"{c} {kinds[c]}, " for c in keep) + "start_pos int, end_pos int, found string, confidence double"

    def run(batches):
        labeller = None
        for b in batches:
            labeller = labeller or Labeller(*shared.value)
            take, made = [], []
            for k, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for s in labeller.segments(t):
                    take.append(k)
                    made.append(s)
            if take:
                index = pa.array(take, pa.int64())
                a, e, lang, p = zip(*made)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(index) for i in range(1 + len(keep))), pa.array(a, pa.int32()), pa.array(e, pa.int32()), pa.array(lang, pa.string()), pa.array(p, pa.float64())], names=[id_col, *keep, "start_pos", "end_pos", "found", "confidence"])

    return rows.select(F.col(id_col).cast("bigint").alias(id_col), *keep, F.col(text_col).alias("__t")).mapInArrow(run, schema)


def _segments(spark, sf_dir: str) -> DataFrame:
    mono = common.read(spark, sf_dir, "mono")
    model = fit(sample(mono, "mono_id", "text", "lang"))
    bits = p6.model(p6.bigram_counts(mono, "text"))
    return label(mono, "mono_id", "text", model, bits, ("lang",))


def p5_segments(spark, sf_dir: str) -> DataFrame:
    """(mono_id, start_pos, end_pos, lang, confidence): the stretches of each language."""
    return _segments(spark, sf_dir).select("mono_id", "start_pos", "end_pos", F.col("found").alias("lang"), F.round("confidence", 4).alias("confidence"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    """(mono_id, lang) of the records whose label is missing or wrong: a row for each language of the text."""
    langs = _segments(spark, sf_dir).groupBy("mono_id").agg(F.first("lang").alias("given"), F.collect_set("found").alias("langs"))
    given = F.lower(F.trim("given"))
    right = F.when(F.size("langs") > 1, F.lit("mixed")).otherwise(F.element_at("langs", 1))
    return langs.where(F.coalesce(given, F.lit("")) != right).select("mono_id", F.explode("langs").alias("lang"))
