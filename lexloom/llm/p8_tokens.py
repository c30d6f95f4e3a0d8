"""Problem 8: encoding a corpus with a public byte-level BPE vocabulary.

The merge table is compiled, as the text asks for it, into a determinised
transducer over bytes.  Of all segmentations of a byte string the one that BPE
makes is the only one in which every two neighbouring tokens are left alone when
they are encoded together.  So each prefix of the input has one last token, and a
reader going from left to right must only hold, for every place from which a
vocabulary entry may still grow, the tokens before that place.  That set, without
the tokens all places share, is a state; what they share is emitted.  States and
arcs are made when first taken and kept, up to ``MAX_ARCS`` of them.

Defined results: null and empty texts give the empty list, blank texts are encoded
as they are, strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed value: the published split pattern of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_ARCS = 400_000
MAX_WORDS = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, blank, id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Bytes in, token ids out, by arcs that are made when first needed."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        # a trie over the vocabulary; node 0 is the root
        self.kids: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for piece, i in ranks.items():
            node = 0
            for byte in piece:
                nxt = self.kids[node].get(byte)
                if nxt is None:
                    nxt = len(self.kids)
                    self.kids[node][byte] = nxt
                    self.kids.append({})
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = i
        self.alone: dict[int, bool] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        # a state: live places, oldest first, as (trie node, tokens pending before the place); the last
        # one is the present place, at the root, and its tokens encode all that was read
        self.states: list[tuple] = [((0, ()),)]
        self.prev: list[int] = [-1]
        self.last_of: list[int] = [-1]
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.index = {(self.states[0], -1): 0}

    def merge(self, piece: bytes) -> list[int]:
        """The rule itself: always the leftmost of the lowest-ranked neighbours."""
        parts = [bytes([b]) for b in piece]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are next to each other; left -1 is the text's start."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if left < 0:
                known = self.merge(self.token[right]) == [right]
            else:
                known = self.compatible(-1, right) and self.merge(self.token[left] + self.token[right]) == [left, right]
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the arc of ``state`` for ``byte``."""
        before = self.prev[state]
        live, done = [], None
        for node, pending in self.states[state]:
            nxt = self.kids[node].get(byte)
            if nxt is None:
                continue
            end = self.ends[nxt]
            if end >= 0 and done is None:
                left = pending[-1] if pending else before
                if self.compatible(left, end):
                    done = (*pending, end)
            if self.kids[nxt]:
                live.append((nxt, pending))
        if done is None:
            raise ValueError("the vocabulary lacks a byte")
        live.append((0, done))
        shared = 0
        paths = [p for _, p in live]
        for column in zip(*paths):
            if any(t != column[0] for t in column):
                break
            shared += 1
        out = done[:shared]
        now = (tuple((n, p[shared:]) for n, p in live), out[-1] if out else before)
        k = self.index.get(now)
        if k is None:
            k = len(self.states)
            self.index[now] = k
            self.states.append(now[0])
            self.prev.append(now[1])
        arc = (k, out)
        self.arcs[state << 8 | byte] = arc
        return arc

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if len(self.arcs) > MAX_ARCS:
            self.reset()
        state, out, arcs = 0, [], self.arcs
        for byte in piece:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                arc = self.step(state, byte)
            state = arc[0]
            if arc[1]:
                out.extend(arc[1])
        out.extend(self.states[state][-1][1])
        return out


class Encoder:
    """Text to ids: split by the pattern, each piece through the transducer, pieces kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.fst = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        kept, parts = self.kept, []
        for piece in self.split(text):
            ids = kept.get(piece)
            if ids is None:
                ids = np.asarray(self.fst.encode(piece.encode("utf-8", "replace")), dtype=np.int32).tobytes()
                if len(kept) > MAX_WORDS:
                    kept.clear()
                if len(piece) <= 64:
                    kept[piece] = ids
            parts.append(ids)
        return b"".join(parts)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist() if text else []


class Utf8Decoder:
    """Incremental UTF-8: bytes come in any portions, whole characters go out.

    The state is the number of continuation bytes awaited, with the range the next
    one must lie in; what can't be a character becomes U+FFFD.
    """

    def __init__(self):
        self.need, self.low, self.high, self.code = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            again = True
            while again:
                again = False
                if self.need:
                    if self.low <= b <= self.high:
                        self.code = self.code << 6 | b & 0x3F
                        self.low, self.high = 0x80, 0xBF
                        self.need -= 1
                        if not self.need:
                            out.append(chr(self.code))
                    else:
                        out.append("�")
                        self.need, self.low, self.high, again = 0, 0x80, 0xBF, True
                elif b < 0x80:
                    out.append(chr(b))
                elif 0xC2 <= b <= 0xDF:
                    self.need, self.code = 1, b & 0x1F
                elif 0xE0 <= b <= 0xEF:
                    self.need, self.code = 2, b & 0x0F
                    self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
                elif 0xF0 <= b <= 0xF4:
                    self.need, self.code = 3, b & 0x07
                    self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
                else:
                    out.append("�")
        return "".join(out)

    def end(self) -> str:
        left, self.need = self.need, 0
        return "�" if left else ""


def decode(ids, token: dict[int, bytes]) -> str:
    """Ids to text, token by token through the incremental decoder."""
    d = Utf8Decoder()
    return "".join(d.feed(token[i]) for i in ids) + d.end()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(load_ranks(path))
    return _ENCODERS[path]


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id, ids): the token ids of every row; no shuffle, one pass."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            packed = [enc.packed(t) if t else b"" for t in b.column(1).to_pylist()]
            sizes = np.fromiter((len(p) >> 2 for p in packed), dtype=np.int64, count=len(packed))
            # lists of an arrow batch have 32-bit offsets: long batches go out in parts
            start = 0
            while start < len(packed):
                stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), 50_000_000)))
                offsets = np.zeros(stop - start + 1, dtype=np.int32)
                np.cumsum(sizes[start:stop], out=offsets[1:])
                offsets = offsets[: len(packed[start:stop]) + 1]
                values = pa.array(np.frombuffer(b"".join(packed[start:stop]), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(offsets) - 1), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[id_col, "ids"])
                start = stop

    return df.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, f"{id_col} bigint, ids array<int>")


def decode_ids(df: DataFrame, id_col: str, ids_col: str, path: str) -> DataFrame:
    """(id, text): the inverse of encode_texts; null ids give null."""

    def run(batches):
        token = encoder(path).fst.token
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else decode(x, token) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"{id_col} bigint, text string")


def tokenizer_path(name: str = "byte_bpe_50k") -> str:
    return f"{common.tokenizer_dir()}/{name}.tiktoken"


def p8_ids(spark, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encode_texts(common.read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())


def p8_roundtrip(spark, sf_dir: str) -> DataFrame:
    """(doc_id, same): whether decoding the ids gives the text back; null and empty texts count as empty."""
    docs = common.read(spark, sf_dir, "documents")
    path = tokenizer_path()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            same = [decode(enc.encode(t), enc.fst.token) == (t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.bool_())], names=["doc_id", "same"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, same boolean")
