"""Problem 6: text that was decoded with a wrong character encoding.

A text is split at blanks.  For each pair of encodings (the one it was read with and
the one it was written in) every piece is encoded back and strictly decoded; the gain
is the drop of a garbling cost in bits.  The stretch with the largest gain is
replaced, whole or part of the text, and the search goes on until nothing is gained,
so nested layers and several stretches come out, however many there are.

The cost of a piece is its length under a bigram model of the letters of the corpus
itself (counted over all rows), with surcharges for characters that running text
hardly has, for mixed scripts and for capitals after small letters.  A record is
garbled if the replaced stretches gain ``MIN_GAIN`` bits.

Defined results: null, empty and blank texts are never garbled; a text with lost
bytes (U+FFFD) is repaired as far as its bytes are there.
"""

from __future__ import annotations

import codecs

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_GAIN = 14.0

#: Pieces whose best stretch is found anew together.
BLOCK = 128

#: Letters of the bigram model; 0 is any other character.
ALPHABET = "абвгдеёжзийклмнопрстуфхцчшщъыьэюяӏ"
SIZE = len(ALPHABET) + 1
_CODE = {c: i + 1 for i, c in enumerate(ALPHABET)} | {c.upper(): i + 1 for i, c in enumerate(ALPHABET)} | {"Ӏ": SIZE - 1}
_TABLE = np.zeros(0x10000, dtype=np.uint8)
for _c, _i in _CODE.items():
    _TABLE[ord(_c)] = _i

#: Characters that running text of any language here may hold.
PLAIN = set(" \t\n\r.,!?:;-–—«»„“”‘’\"'()[]{}…№%&/*+=<>@#$^_|~\\`§°•·") | set("0123456789")

_CODES = {ord(c): chr(i) for c, i in _CODE.items()}
_LETTERS = regex.compile("([а-яёА-ЯЁ]+)[.,!?:;]*")
_WORD = regex.compile("[А-Я]?[а-яӏӀI1]+(?:-[а-яӏӀI1]+)?[-.,!?:;…]*")
#: A capital right after a small letter.
_CHANGE = regex.compile("(?<=[а-яё])[А-ЯЁ]")

#: Lines that are drawn, if a piece has nothing else.
FRAME = set("─│┌┐└┘├┤┬┴┼═║╔╗╚╝╠╣╦╩╬▀▄█░▒▓■.,;:!?()\"'")

#: What may be garbled: worth a closer look.
SUSPECT = regex.compile(r"[\u0080-¦¨-¯²-ɏʰ-˿Ђ-Џђ-џҐґ†‡‰‹›€™∀-⌠─-◿ﬁﬂ�]|[а-яё][А-ЯЁ]|[А-ЯЁ]{2}|[Р-Т][\u0080-ÿ]|вЂ")


def _views() -> dict[str, dict[str, int]]:
    """Character to byte, by the encoding a text was read with; unused bytes stand for themselves."""
    made = {}
    for name in ("cp1251", "cp1252", "latin-1", "cp866", "koi8-r", "mac-cyrillic"):
        table = {}
        for b in range(256):
            try:
                c = bytes([b]).decode(name)
            except UnicodeDecodeError:
                c = chr(b)
            table[ord(c)] = b
        made[name] = table
    made["cp1251"][0xFFFD] = 0x98
    for b in range(0x80, 0xA0):
        made["cp1252"].setdefault(b, b)
    return made


VIEWS = _views()
#: (read with, written in)
PAIRS = tuple((v, t) for v in VIEWS for t in ("utf-8", "cp1251", "koi8-r", "cp866") if v != t)
_BY_VIEW = [(v, [(k, t) for k, (w, t) in enumerate(PAIRS) if w == v]) for v in VIEWS]
#: No open stretch of a pair: (gain, first piece).
NONE = (0.0, -1)


def written(piece: str, view: str, lost: bool = False) -> bytes | None:
    """The bytes of a piece that was read as ``view``; ``lost`` ones are guessed from UTF-8 lead bytes."""
    if not lost:
        try:
            return codecs.charmap_encode(piece, "strict", VIEWS[view])[0]
        except UnicodeEncodeError:
            return None
    out = bytearray()
    for c in piece:
        b = VIEWS[view].get(ord(c))
        if b is None:
            if c != "\ufffd":
                return None
            # a lost byte: the likeliest one after its lead byte (Ð; с; Н)
            b = {0xC3: 0x90, 0xD1: 0x81}.get(out[-1] if out else 0, 0x9D)
        out.append(b)
    return bytes(out)


def decodings(piece: str) -> list[tuple[int, str]]:
    """(pair number, piece as written) of every pair of encodings that decodes strictly."""
    out = []
    for view, own in _BY_VIEW:
        raw = written(piece, view)
        for k, true in own:
            data = written(piece, view, True) if raw is None and view == "cp1252" and true == "utf-8" and "\ufffd" in piece else raw
            if data is not None:
                try:
                    out.append((k, data.decode(true)))
                except UnicodeDecodeError:
                    pass
    return out


def back(piece: str, view: str, true: str) -> str | None:
    """The piece as it was written, if it was written in ``true`` and read as ``view``."""
    return dict(decodings(piece)).get(PAIRS.index((view, true)))


def bigram_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(k, n): counts of neighbouring letters; at most SIZE² rows come out of each batch."""

    def run(batches):
        total = np.zeros(SIZE * SIZE, dtype=np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    a = _TABLE[np.frombuffer(t.encode("utf-16-le", "replace"), dtype=np.uint16)].astype(np.int32)
                    total += np.bincount(a[:-1] * SIZE + a[1:], minlength=SIZE * SIZE)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k], pa.int64())], names=["k", "n"])

    return df.select(F.col(text_col).alias("t")).where("t is not null").mapInArrow(run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n"))


def model(*counts: DataFrame) -> np.ndarray:
    """Bits of each letter after each letter; the collected table has SIZE² numbers whatever the corpus."""
    total = np.full((SIZE, SIZE), 0.05)
    for df in counts:
        for r in df.collect():
            total[r.k // SIZE, r.k % SIZE] += r.n
    total[:, 0] = np.maximum(total[:, 0], 1)
    return -np.log2(total / total.sum(axis=1, keepdims=True))


class Repairer:
    def __init__(self, bits: np.ndarray):
        self.bits = [list(map(float, row)) for row in bits]
        self.costs: dict[str, float] = {}
        self.decoded: dict[str, list] = {}
        self.gaining: dict[str, list] = {}

    def cost(self, piece: str) -> float:
        """Garbling cost of a piece in bits."""
        known = self.costs.get(piece)
        if known is not None:
            return known
        plain = _LETTERS.fullmatch(piece)
        if plain:
            total = self.letters(plain.group(1)) + 2 * (len(piece) - plain.end(1))
        else:
            total = self.signs(piece)
        if len(self.costs) > 300_000:
            self.costs.clear()
        self.costs[piece] = total
        return total

    def letters(self, word: str) -> float:
        """Cost of a piece that has nothing but letters of the alphabet, the common case."""
        codes = word.translate(_CODES).encode("latin-1")
        total = self.bits[0][codes[0]] + sum([self.bits[a][b] for a, b in zip(codes, codes[1:])])
        if not word.islower():
            if len(word) > 2 and word.isupper():
                total += 4
            total += 6 * len(_CHANGE.findall(word))
        return total

    def signs(self, piece: str, limit: float = 1e18) -> float:
        """Cost of any piece; a lower bound above ``limit`` if it is dearer than that."""
        total, before, kind = 0.0, 0, ""
        lower = False
        if piece.upper() == piece and sum(map(str.isalpha, piece)) > 2:
            total += 4
        for at, c in enumerate(piece):
            if total > limit:
                break
            code = _CODE.get(c, 0)
            if code:
                total += self.bits[before][code] if before or kind != "c" else 5.0
                if kind == "l":
                    total += 6
                up = c.isupper() and c != "Ӏ"
                if up and lower:
                    total += 6
                lower = not up and code != SIZE - 1
                kind = "c"
            elif c in PLAIN:
                inside = kind in ("c", "l") and at + 1 < len(piece) and piece[at + 1].isalpha()
                # a sign of the upper half stuck to a small letter stands for a capital
                stuck = c in "…„“”‘’•—–" and at + 1 < len(piece) and piece[at + 1].islower()
                total += 12 if c in "·№°§•" and kind in ("c", "l") or inside and c in "„“”‘’«»—–" else 8 if stuck else 2
                lower, kind = False, "p"
            elif "a" <= c <= "z" or "A" <= c <= "Z":
                total += 4
                # a palochka may be written as I
                if kind == "c" and c not in "Ii":
                    total += 6
                lower, kind = False, ("c" if c in "Ii" and kind == "c" else "l")
            elif "Ā" > c >= "\x80" or c == "�":
                total += 12
                lower, kind = False, "x"
            elif c in "ЂЉЊЋЈЏЄІЇ" and at + 1 < len(piece) and piece[at + 1].islower() and kind in ("", "p"):
                total += 5  # a name of another Cyrillic alphabet
                lower, kind = False, "c"
            elif c.isalpha() and not "Ѐ" <= c <= "ӿ" and not "Ā" <= c < "ʰ":
                total += 22 if kind in ("c", "l") else 14
                lower, kind = False, "o"
            else:
                total += 14
                lower, kind = False, "x"
            before = code
        return total

    def tried(self, piece: str) -> list:
        """(pair number, piece as written) of every pair that decodes; none for plain ASCII."""
        known = self.decoded.get(piece)
        if known is None:
            known = [] if piece.isascii() else decodings(piece)
            if len(self.decoded) > 100_000:
                self.decoded.clear()
            self.decoded[piece] = known
        return known

    def gain(self, piece: str, was: str) -> float:
        """Drop of the cost if a piece was written as ``was``."""
        if all(c in FRAME for c in piece):
            return 0.0  # drawn: no reason of its own to be decoded
        lost = any(map(str.isalpha, piece)) and not any(map(str.isalpha, was))
        return self.cost(piece) - self.cost(was) - (12 if lost else 0)

    def gains(self, piece: str) -> list:
        """(pair number, gain) of the pairs that gain by this piece alone."""
        known = self.gaining.get(piece)
        if known is None:
            known = []
            # plain words don't gain
            if not piece.isascii() and not _WORD.fullmatch(piece) and not all(c in FRAME for c in piece):
                now = self.cost(piece)
                for k, was in self.tried(piece):
                    cost = self.costs.get(was)
                    if cost is None:
                        plain = _LETTERS.fullmatch(was)
                        cost = self.letters(plain.group(1)) + 2 * (len(was) - plain.end(1)) if plain else self.signs(was, now)
                    if cost < now:
                        known.append((k, now - cost))
            if len(self.gaining) > 200_000:
                self.gaining.clear()
            self.gaining[piece] = known
        return known

    def layer(self, pieces: list[str], alive: set[int], run: list, start: int, end: int) -> tuple[tuple[float, int, int, int], list]:
        """Best (gain, pair, first, last) over the pairs ``alive`` and the stretches that end in [start, end), and the open stretches at ``end``.

        ``run`` are the open ones at ``start``; a piece that a pair can't decode ends its stretch.
        """
        best = (0.0, 0, 0, -1)
        for i in range(start, end):
            piece = pieces[i]
            if not piece or piece.isascii():
                continue
            now = [NONE] * len(PAIRS)
            for k, was in self.tried(piece):
                if k not in alive:
                    continue
                gain = self.gain(piece, was)
                total, first = run[k]
                total, first = (total + gain, first) if total > 0 else (gain, i)
                if total > 0:
                    now[k] = (total, first)
                    if total > best[0]:
                        best = (total, k, first, i)
            run = now
        return best, run

    def reach(self, pieces: list[str], k: int, at: int, way: int) -> int:
        """The end of a stretch, moved over neighbours that look drawn but are letters in the stretch's encoding."""
        i = at + way
        while 0 <= i < len(pieces):
            piece = pieces[i]
            if piece and not piece.isspace():
                was = None if piece.isascii() or not all(c in FRAME for c in piece) else next((w for p, w in self.tried(piece) if p == k), None)
                if was is None or not any(c.isalpha() for c in was):
                    break
                at = i
            i += way
        return at

    def repair(self, text: str) -> tuple[str, float]:
        """The text as it was, and the gain in bits.

        The best stretch of all is replaced, then the next, until none gains enough.  Decoding
        makes no blanks, so the pieces keep their places; after a replacement only the blocks
        whose open stretches have changed are looked at again.
        """
        # no stretch gains more than all its pieces that gain by themselves, so most pairs need no search
        most = [0.0] * len(PAIRS)
        for piece in text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" "):
            known = self.gaining.get(piece)
            for k, gain in self.gains(piece) if known is None else known:
                most[k] += gain
        if max(most) < MIN_GAIN:
            return text, 0.0
        alive = {k for k, x in enumerate(most) if x >= MIN_GAIN}
        pieces = regex.split(r"([ \n\r\t]+)", text)
        blocks = -(-len(pieces) // BLOCK)
        opened = [[NONE] * len(PAIRS)] + [None] * blocks
        bests = [None] * blocks
        # a text that comes back, which drawn pieces could cause, ends the search
        state = 0
        seen = {state}
        gained = 0.0
        low, high = 0, len(pieces) - 1
        while True:
            for n in range(low // BLOCK, blocks):
                bests[n], run = self.layer(pieces, alive, opened[n], n * BLOCK, min((n + 1) * BLOCK, len(pieces)))
                same = run == opened[n + 1]
                opened[n + 1] = run
                if same and (n + 1) * BLOCK > high:
                    break
            gain, k, first, last = max(bests, key=lambda b: b[0])
            if gain < MIN_GAIN:
                break
            low, high = self.reach(pieces, k, first, -1), self.reach(pieces, k, last, 1)
            for i in range(low, high + 1):
                if not pieces[i].isascii():
                    was = next(was for p, was in self.tried(pieces[i]) if p == k)
                    state ^= hash((i, pieces[i])) ^ hash((i, was))
                    pieces[i] = was
                    for p, x in self.gains(was):
                        most[p] += x
            if any(x >= MIN_GAIN and p not in alive for p, x in enumerate(most)):
                # a layer below may need another pair, which no piece was tried with
                alive = {p for p, x in enumerate(most) if x >= MIN_GAIN}
                low, high = 0, len(pieces) - 1
                opened[1:], bests = [None] * blocks, [None] * blocks
            gained += gain
            if state in seen:
                break
            seen.add(state)
        return "".join(pieces), gained


_MADE: dict[int, Repairer] = {}


def repairer(shared) -> Repairer:
    """One repairer per Python worker and broadcast."""
    key = id(shared.value)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Repairer(shared.value)
    return _MADE[key]


def fix(df: DataFrame, id_col: str, text_col: str, bits, only_garbled: bool = True) -> DataFrame:
    """(id, text, gain) of the garbled rows, or of all rows; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        rep = repairer(shared)
        for b in batches:
            ids, texts, gains = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                new, gain = rep.repair(t) if t and SUSPECT.search(t) else (t, 0.0)
                if gain or not only_garbled:
                    ids.append(k)
                    texts.append(new)
                    gains.append(gain)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(gains, pa.float64())], names=[id_col, "text", "gain"])

    return df.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("__t")).mapInArrow(run, f"{id_col} bigint, text string, gain double")


def _both(spark, sf_dir):
    return common.read(spark, sf_dir, "mono"), common.read(spark, sf_dir, "parallel_ing_rus")


def p6_repaired(spark, sf_dir: str) -> DataFrame:
    """(table_name, row_id, text, gain): every garbled record with its restored text."""
    mono, par = _both(spark, sf_dir)
    bits = model(bigram_counts(mono, "text"), bigram_counts(par, "rus"))
    out = None
    for name, df, key, col in (("mono", mono, "mono_id", "text"), ("parallel_ing_rus", par, "pair_id", "rus")):
        part = fix(df, key, col, bits).select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), "text", F.round("gain", 3).alias("gain"))
        out = part if out is None else out.unionByName(part)
    return out


def p6_found(spark, sf_dir: str) -> DataFrame:
    return p6_repaired(spark, sf_dir).select("table_name", "row_id")
