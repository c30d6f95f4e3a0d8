"""Problem 9: passages of held-out items inside a training corpus.

Every shard of the corpus (an Arrow batch of whole documents) gets a suffix array
over its words; every suffix of every test item is looked up in it by binary
search.  The range of suffixes that agree in the first ``min_words`` words gives
all places where the passage stands; each is followed on to the longest verbatim
match.  Words that no test item has can't be in a match, so a shard's array holds
only its runs of item words that are long enough.  Shards are searched
independently, so nothing of the corpus is shuffled or collected.

Words are maximal runs of letters and digits after lower-casing; a palochka is one
letter in all its spellings and ё is е.  Null, empty and shorter texts hold no item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 10
#: Items are sent to the executors in blocks of this many bytes of text; more items mean more passes.
ITEM_BLOCK_BYTES = 16 << 20
#: Hits that are looked at together.
SLICE = 1 << 20
FOLD = common.PALOCHKA_FOLD | {ord("ё"): "е"}
_LETTERS = common.WORD.findall


def item_words(text: str) -> list[str]:
    return _LETTERS(text.lower().translate(FOLD))


class Items:
    """The test side: word numbers of all items in one array, 0 after each item."""

    def __init__(self, rows: list[tuple[int, str]], min_words: int):
        self.vocab: dict[str, int] = {}
        seq, owner = [], []
        for item_id, text in rows:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in item_words(text or "")]
            if len(ids) >= min_words:
                seq += [*ids, 0]
                owner += [item_id] * (len(ids) + 1)
        self.seq = np.asarray(seq + [0] * min_words, dtype=np.int32)
        self.owner = np.asarray(owner, dtype=np.int64)
        n = len(owner)
        stop = np.flatnonzero(self.seq[:n] == 0)
        left = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n) if n else np.zeros(0, dtype=np.int64)
        self.suffixes = np.flatnonzero(left >= min_words)


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first ``depth`` entries or more, by prefix doubling."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth and rank.max(initial=0) < n - 1:
        second = np.zeros(n, dtype=np.int64)
        if k < n:
            second[:-k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, dtype=np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, k = new, 2 * k
    return order


def search(seq: np.ndarray, order: np.ndarray, items: Items, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For every item suffix the range of ``order`` that agrees with it in ``m`` words."""
    pad = np.concatenate([seq, np.zeros(m, dtype=seq.dtype)])
    want = items.seq[items.suffixes[:, None] + np.arange(m)]

    def bound(upper: bool) -> np.ndarray:
        lo = np.zeros(len(want), dtype=np.int64)
        hi = np.full(len(want), len(order), dtype=np.int64)
        while (lo < hi).any():
            mid = np.minimum((lo + hi) >> 1, len(order) - 1)
            have = pad[order[mid][:, None] + np.arange(m)]
            differs = have != want
            first = differs.argmax(axis=1)
            rows = np.arange(len(want))
            less = differs.any(axis=1) & (have[rows, first] < want[rows, first])
            go = less | (upper & ~differs.any(axis=1))
            active = lo < hi
            lo = np.where(active & go, mid + 1, lo)
            hi = np.where(active & ~go, mid, hi)
        return lo

    return bound(False), bound(True)


def leaks_in(texts: list, items: Items, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item id, first word, words) of the longest match of each text and item."""
    get, parts, rows, starts = items.vocab.get, [], [], []
    for k, text in enumerate(texts):
        if not text:
            continue
        a = np.asarray([get(w, 0) for w in _LETTERS(text.lower().translate(FOLD))], dtype=np.int32)
        if len(a) < m:
            continue
        cuts = np.flatnonzero(np.concatenate([[True], a == 0, [True]]))
        for c in np.flatnonzero(np.diff(cuts) > m):
            lo, hi = cuts[c], cuts[c + 1] - 1
            parts += [a[lo:hi], np.zeros(1, dtype=np.int32)]
            rows.append((k, hi - lo + 1))
            starts.append(np.arange(lo, hi + 1))
    none = np.zeros(0, dtype=np.int64)
    if not parts or not len(items.suffixes):
        return none, none, none, none
    seq = np.concatenate(parts)
    row = np.repeat([r for r, _ in rows], [n for _, n in rows])
    word = np.concatenate(starts)
    order = suffix_array(seq, m)
    lo, hi = search(seq, order, items, m)
    upto = np.concatenate([[0], np.cumsum(hi - lo)])
    a, b = np.concatenate([seq, [0]]), np.concatenate([items.seq, [0]])
    kept = [(none, none, none, none)]
    # a passage in every text has as many hits as there are texts, so they are taken in slices of one size
    for start in range(0, int(upto[-1]), SLICE):
        hit = np.arange(start, min(start + SLICE, int(upto[-1])))
        i = np.searchsorted(upto, hit, side="right") - 1
        q, at = items.suffixes[i], order[lo[i] + hit - upto[i]]
        size = np.full(len(q), m, dtype=np.int64)
        grow = np.arange(len(q))
        while len(grow):
            x, y = a[np.minimum(at[grow] + size[grow], len(seq))], b[np.minimum(q[grow] + size[grow], len(items.seq))]
            grow = grow[(x == y) & (x > 0)]
            size[grow] += 1
        kept.append(longest(row[at], items.owner[q], word[at], size))
    return longest(*(np.concatenate(x) for x in zip(*kept)))


def longest(r: np.ndarray, item: np.ndarray, w: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The longest match of each row and item, the first of several."""
    best = np.lexsort((w, -size, item, r))
    r, item, w, size = r[best], item[best], w[best], size[best]
    keep = np.ones(len(r), dtype=bool)
    keep[1:] = (r[1:] != r[:-1]) | (item[1:] != item[:-1])
    return r[keep], item[keep], w[keep], size[keep]


_MADE: list = [None, None]


def side_of(shared, min_words: int) -> Items:
    """The items of a broadcast, made once in a Python worker."""
    key = (shared.value, min_words)
    if _MADE[0] is None or _MADE[0][0] is not key[0] or _MADE[0][1] != min_words:
        _MADE[:] = [key, Items(shared.value, min_words)]
    return _MADE[1]


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc, item, first_word, n_words): longest verbatim match, first_word counted from 1.

    Rows repeated in either table count once.  An empty table gives an empty result.
    """
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    spark = docs.sparkSession
    items = items.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text_col).alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // ITEM_BLOCK_BYTES) or 1
    schema = f"{doc_col} bigint, {item_col} bigint, first_word int, n_words int"
    found = None
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([(r.i, r.t) for r in own.toLocalIterator()])

        def run(batches, shared=shared):
            side = side_of(shared, min_words)
            for b in batches:
                r, item, w, n = leaks_in(b.column(1).to_pylist(), side, min_words)
                if len(r):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(item, pa.int64()), pa.array(w + 1, pa.int32()), pa.array(n, pa.int32())], names=[doc_col, item_col, "first_word", "n_words"])

        part = docs.select(F.col(doc_col).cast("bigint").alias(doc_col), F.col(text_col).alias("__t")).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found.groupBy(doc_col, item_col).agg(F.max(F.struct("n_words", (-F.col("first_word")).alias("w"))).alias("m")).select(doc_col, item_col, (-F.col("m.w")).alias("first_word"), F.col("m.n_words").alias("n_words"))


def p9_found(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every document that shares ten words in a row with an item."""
    return find_leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "test_items")).select("doc_id", "item_id")


def p9_leaked_items(spark, sf_dir: str) -> DataFrame:
    """(item_id, n_docs, longest): how far each test item leaked."""
    leaks = find_leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "test_items"))
    return leaks.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_words").alias("longest"))


def p9_clean(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars) of the documents that hold no item; rows with a null id stay."""
    docs = common.read(spark, sf_dir, "documents")
    return docs.join(p9_found(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "n_chars")


_WORDS = "regexp_extract_all(translate(lower(text), '1iё', 'ӏӏе'), '[\\pL\\pN]+')"
_RUNS = "select {0}, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) as g from (select {0}, " + _WORDS + " as w from {1} where text is not null)"
_LEAKS = f"(select distinct doc_id, item_id from ({_RUNS.format('doc_id', 'documents')}) d join ({_RUNS.format('item_id', 'test_items')}) i using (g))"
SQL = {
    "p9_found": f"select doc_id, item_id from {_LEAKS}",
    "p9_clean": f"select doc_id, n_chars from documents where doc_id is null or doc_id not in (select doc_id from {_LEAKS})",
}
