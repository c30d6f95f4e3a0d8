"""Grouping, splitting and near-duplicates against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import common
from lexloom.llm import p3_splits as P3
from lexloom.llm import p4_near as P4


def components(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for p, s, e in rows:
        for k in (("s", s.strip().lower()) if s and s.strip() else None, ("e", " ".join(e.lower().split())) if e and e.strip() else None):
            if k:
                parent[find(("p", p))] = find(k)
    low = {}
    for p, _, _ in rows:
        low[find(("p", p))] = min(low.get(find(("p", p)), p), p)
    return {p: low[find(("p", p))] for p, _, _ in rows}


def test_groups_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, "", " ", *(f"S{rng.randint(0, 40)} " for _ in range(6))]), rng.choice([None, " ", *(f"t  {rng.randint(0, 60)}" for _ in range(6))])) for k in range(1, 200)]
    df = spark.createDataFrame([(p, s, e, 1) for p, s, e in rows], "pair_id bigint, source string, ing string, l int")
    got = {r.pair_id: r.group_id for r in P3.groups(df).collect()}
    assert got == components(rows)


def test_chain_and_repeats(spark):
    # a chain of records linked in turn by source and by text
    rows = [(k + 1, f"s{(k + 1) // 2}", f"e{k // 2}") for k in range(60)]
    df = spark.createDataFrame([*rows, rows[3], (None, "s1", "e1")], "pair_id bigint, source string, ing string")
    got = P3.groups(df).collect()
    assert len(got) == 60 and {r.group_id for r in got} == {1}
    assert P3.groups(df.where("pair_id < 0")).count() == 0


def test_splits(spark):
    rng = random.Random(2)
    rows = [(k, f"s{rng.randint(0, 120)}", f"unique {k}", rng.choice(["a", "b", None])) for k in range(1, 1500)]
    df = spark.createDataFrame(rows, "pair_id bigint, source string, ing string, pair_type string").withColumn("split", F.lit("x")).withColumn("group_id", F.lit(0))
    out = P3.splits(df).collect()
    assert len(out) == 1499
    groups = {}
    for r in out:
        assert groups.setdefault(r.group_id, r.split) == r.split
    n = {s: sum(r.split == s for r in out) / 1499 for s, _ in P3.SPLITS}
    assert abs(n["train"] - 0.8) < 0.03 and abs(n["test"] - 0.1) < 0.03
    with pytest.raises(ValueError):
        P3.splits(df, (("a", 0.5), ("b", 0.2)))


def texts(n, seed):
    rng = random.Random(seed)
    vocab = ["сло" + "".join(rng.choice("абвгдежз") for _ in range(5)) for _ in range(140)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            a, b = (t.split() for t in rng.choice(rows)[1:])
            for w in (a, b):
                for _ in range(rng.randint(0, 9)):
                    w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            a, b = ([rng.choice(vocab) for _ in range(rng.randint(18, 45))] for _ in range(2))
        rows.append((k, " ".join(a), " ".join(b)))
    return rows


def test_near_brute_force(spark):
    rows = [*texts(220, 3), (500, None, "x"), (501, "", ""), (502, "а " * 100, "б " * 100)]
    rows.append((503, rows[5][1], rows[5][2]))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "pair_id bigint, ing string, rus string, rep int, key int")
    sets = {p: (set(common.words(a or "")), set(common.words(b or ""))) for p, a, b in rows}
    sets = {p: s for p, s in sets.items() if min(map(len, s)) >= 20}
    want = {(p, q) for p in sets for q in sets if p < q and all(len(x & y) >= 0.6 * len(x | y) for x, y in zip(sets[p], sets[q]))}
    got = P4.near_pairs(df).collect()
    assert len(want) > 20
    assert {(r.pair_id_a, r.pair_id_b) for r in got} == want and len(got) == len(want)
    repeated = P4.near_pairs(df.unionByName(df.where("pair_id < 50"))).count()
    assert repeated == len(want)
    assert P4.near_pairs(df.where("pair_id < 0")).count() == 0


def test_long_records_meet():
    # sets of all sizes, similar ones of different classes too, have a key in common, and no more keys than some a word
    rng = np.random.default_rng(11)
    df = rng.integers(1, 400, P4.BUCKETS)
    universe = rng.integers(0, 1 << 47, 20_000)
    for size in (20, 71, 90, 119, 121, 150, 239, 241, 400, 700, 1000, 2000):
        for ratio in (0.62, 0.8, 1.0):
            shared = int(np.ceil(0.6 / 1.6 * (size + max(20, int(ratio * size)))))
            b = max(20, int(ratio * size), shared)
            words = rng.permutation(universe)
            x, y = words[:size], np.concatenate((words[:shared], words[size : size + b - shared]))
            if len(np.intersect1d(x, y)) < 0.6 * len(np.union1d(x, y)):
                continue
            for n in (1000, 40_000):  # few rare words, and many
                kx, ky = (P4.block_keys(np.sort(z), df, n, 0.6, 20) for z in (x, y))
                assert set(kx) & set(ky)
                if size > 300:
                    assert len(kx) < 15 * size


def test_long_and_hot_brute_force(spark):
    # very long texts, and a passage that every other record begins with
    rng = random.Random(12)
    vocab = ["сл" + "".join(rng.choice("абвгдежзик") for _ in range(6)) for _ in range(9000)]
    start = " ".join(vocab[:15])
    rows = []
    for k in range(60):
        if k % 6 == 5:
            a = rows[-5][1].split()
            for _ in range(len(a) // 6):
                a[rng.randrange(len(a))] = rng.choice(vocab)
            rows.append((k, " ".join(a), rows[-5][2]))
        else:
            own = " ".join(rng.sample(vocab, rng.choice([25, 60, 300, 2000])))
            rows.append((k, start + " " + own if k % 2 else own, " ".join(rng.sample(vocab, 30))))
    df = spark.createDataFrame(rows, "pair_id bigint, ing string, rus string")
    sets = {p: (set(common.words(a)), set(common.words(b))) for p, a, b in rows}
    want = {(p, q) for p in sets for q in sets if p < q and all(len(x & y) >= 0.6 * len(x | y) for x, y in zip(sets[p], sets[q]))}
    got = [(r.pair_id_a, r.pair_id_b) for r in P4.near_pairs(df).collect()]
    assert len(want) >= 8 and set(got) == want and len(got) == len(want)


def test_fingerprint_bound():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 60, 30)) * 7919 % (1 << 47) for _ in range(2))
        (f1, g1), (f2, g2) = P4.fingerprint(x), P4.fingerprint(y)
        low = (1 << P4.FINGERPRINT) - 1
        assert ((f1 ^ f2) & low).bit_count() + (g1 ^ g2).bit_count() <= len(np.setxor1d(x, y))
        assert f1 >> P4.FINGERPRINT == len(x)
        assert np.array_equal(P4.unpack(P4.pack(x)), x)


def test_least_shared():
    for a in range(20, 60):
        shared = min(s for b in range(20, 120) for s in range(a + 1) if s <= b and s >= 0.6 * (a + b - s))
        assert P4.least_shared(a, 0.6, 20) == shared
