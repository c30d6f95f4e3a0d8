"""Problem 3: train, validation and test splits that keep related records together.

Records and their entities (source, ing text) form a bipartite graph; the groups are
its connected components.  A source or text that holds a third of all rows is one
node, made by an aggregate with map-side combining, so the graph that the iteration
works on has one edge for each source and each text that stands in two or more
sources, however many rows there are.  On it the smallest record id is propagated
from entity to entity until nothing changes; each round also follows the label's own
label, so long chains take a logarithmic number of rounds.  Rounds are cut by
checkpoints.

Defined results: rows with a null id are left out; a source or text that is null or
blank links nothing; repeated rows count once.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROUNDS = 60
#: Groups of at least this share of all rows are assigned one by one, the others in this many hashed bundles.
LARGE_SHARE, BUNDLES, LABELS = 0.002, 512, 64
SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def _key(c: Column) -> Column:
    """128-bit key of a normalised string; null and blank have none."""
    return F.when(c != "", F.unhex(F.md5(c)))


def source_key(c: Column) -> Column:
    return _key(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))


def text_key(c: Column) -> Column:
    return _key(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), "^ | $", ""))


def groups(rows: DataFrame, id_col: str = "pair_id", source_col: str = "source", text_col: str = "ing") -> DataFrame:
    """(id, group_id): every record with the smallest id of its component."""
    # read by five stages below, so the keys are made once
    base = common.checkpoint(rows.select(F.col(id_col).cast("bigint").alias("p"), source_key(F.col(source_col)).alias("s"), text_key(F.col(text_col)).alias("e")).where("p is not null"))
    links = base.where("e is not null").groupBy("e", "s").agg(F.min("p").alias("p"))
    texts = links.groupBy("e").agg(F.min("p").alias("p"), F.min("s").alias("s0"), F.max("s").alias("s1"))
    # each source starts with the smallest id that it sees in its rows or in the texts it holds
    own = base.where("s is not null").groupBy("s").agg(F.min("p").alias("rep"))
    seen = links.where("s is not null").join(texts.select("e", F.col("p").alias("m")), "e").groupBy("s").agg(F.min("m").alias("m"))
    nodes = common.checkpoint(own.join(seen, "s", "left").select("s", "rep", F.least("rep", F.coalesce("m", "rep")).alias("l")))
    edges = common.checkpoint(links.where("s is not null").join(texts.where("s0 <> s1").select("e"), "e").select("s", "e"))
    for _ in range(MAX_ROUNDS):
        at = edges.join(nodes.select("s", "l"), "s").groupBy("e").agg(F.min("l").alias("l"))
        got = edges.join(at, "e").groupBy("s").agg(F.min("l").alias("got"))
        near = nodes.join(got, "s", "left").select("s", "rep", F.col("l").alias("old"), F.least("l", F.coalesce("got", "l")).alias("l"))
        # the label's own label
        up = nodes.select(F.col("rep").alias("l"), F.col("l").alias("up")).groupBy("l").agg(F.min("up").alias("up"))
        now = common.checkpoint(near.join(up, "l", "left").select("s", "rep", "old", F.least("l", F.coalesce("up", "l")).alias("l")))
        changed = now.where("l < old").limit(1).count()
        nodes = now.drop("old")
        if not changed:
            break
    else:
        raise RuntimeError("labels still change; raise MAX_ROUNDS")
    labels = nodes.select("s", "l")
    text_labels = texts.where("s0 is not null").join(labels.withColumnRenamed("s", "s0"), "s0").select("e", "p", "l").unionByName(texts.where("s0 is null").select("e", "p", F.col("p").alias("l"))).select("e", F.coalesce("l", "p").alias("l"))
    with_source = base.where("s is not null").select("p", "s").join(labels, "s").select("p", "l")
    # every text that is not null has a label; rows without any key need no join, where they would meet in one task
    without = base.where("s is null and e is not null").select("p", "e").join(text_labels, "e").select("p", "l")
    alone = base.where("s is null and e is null").select("p", F.col("p").alias("l"))
    return with_source.unionByName(without).unionByName(alone).groupBy("p").agg(F.min("l").alias("group_id")).select(F.col("p").alias(id_col), "group_id")


def assign(counts: DataFrame, proportions=SPLITS) -> DataFrame:
    """(unit, split) from (unit, label, n): greedy, largest first, least deviation of label counts."""
    sizes: dict = defaultdict(lambda: defaultdict(int))
    total: dict = defaultdict(int)
    for r in counts.collect():  # bounded: 1 / LARGE_SHARE + BUNDLES units, LABELS labels
        sizes[r.unit][r.label] += r.n
        total[r.label] += r.n
    have = {name: defaultdict(int) for name, _ in proportions}
    chosen = []
    for unit, own in sorted(sizes.items(), key=lambda x: (-sum(x[1].values()), x[0])):

        def cost(name: str, share: float, own=own) -> float:
            # change of the squared, scaled deviation from the wanted count of each label and of all
            labels = sum((((have[name][k] + n - share * total[k]) ** 2 - (have[name][k] - share * total[k]) ** 2) / (share * total[k])) for k, n in own.items())
            n, had, want = sum(own.values()), sum(have[name].values()), share * sum(total.values())
            return labels + ((had + n - want) ** 2 - (had - want) ** 2) / want

        best = min(proportions, key=lambda x: cost(*x))[0]
        chosen.append((unit, best))
        for k, n in own.items():
            have[best][k] += n
    return counts.sparkSession.createDataFrame(chosen, "unit bigint, split string")


def splits(rows: DataFrame, proportions=SPLITS, id_col: str = "pair_id", source_col: str = "source", text_col: str = "ing", label_col: str = "pair_type") -> DataFrame:
    """(id, group_id, split): every group in one split, label counts as near the proportions as groups allow."""
    if not proportions or any(p <= 0 for _, p in proportions) or abs(sum(p for _, p in proportions) - 1) > 1e-9:
        raise ValueError("proportions must be positive and sum to 1")
    group = common.checkpoint(groups(rows, id_col, source_col, text_col))
    label = rows.select(F.col(id_col).cast("bigint").alias(id_col), F.pmod(F.xxhash64(F.coalesce(label_col, F.lit(""))), F.lit(LABELS)).alias("label")).groupBy(id_col).agg(F.min("label").alias("label"))
    counts = group.join(label, id_col).groupBy("group_id", "label").agg(F.count("*").alias("n"))
    counts = common.checkpoint(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    large = counts.groupBy("group_id").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1.0, LARGE_SHARE * total)).select("group_id", F.lit(True).alias("large"))
    # a large group is its own unit, numbered by its id; the others share negative numbers
    bundle = F.when(F.col("large"), F.col("group_id")).otherwise(-1 - F.pmod(F.xxhash64("group_id"), F.lit(BUNDLES)))
    units = counts.join(F.broadcast(large), "group_id", "left").select("group_id", bundle.alias("unit"), "label", "n")  # at most 1 / LARGE_SHARE rows
    of = F.broadcast(assign(units.groupBy("unit", "label").agg(F.sum("n").alias("n")), proportions))
    return group.join(F.broadcast(large), "group_id", "left").withColumn("unit", bundle).join(of, "unit").select(id_col, "group_id", "split")


def p3_found(spark, sf_dir: str) -> DataFrame:
    return groups(common.read(spark, sf_dir, "parallel_ing_rus"))


def p3_splits(spark, sf_dir: str) -> DataFrame:
    return splits(common.read(spark, sf_dir, "parallel_ing_rus"))


def p3_balance(spark, sf_dir: str) -> DataFrame:
    """(split, pair_type, n): the label distribution of each split."""
    rows = common.read(spark, sf_dir, "parallel_ing_rus")
    return splits(rows).select("pair_id", "split").join(rows.select("pair_id", "pair_type"), "pair_id").groupBy("split", "pair_type").agg(F.count("*").alias("n"))


_S = "regexp_replace(lower(source), '^\\s+|\\s+$', '', 'g')"
_E = "regexp_replace(regexp_replace(lower(ing), '[\\s\\x{85}\\x{A0}\\x{2028}\\x{2029}\\x{202F}\\x{3000}\\x{2000}-\\x{200A}]+', ' ', 'g'), '^ | $', '', 'g')"
SQL = {
    "p3_found": f"""
with recursive k as (select pair_id, 's' || {_S} as k from parallel_ing_rus where {_S} <> '' union select pair_id, 'e' || {_E} from parallel_ing_rus where {_E} <> ''),
r as (select pair_id as p, k from k union select r.p, b.k from r join k a on a.k = r.k join k b on b.pair_id = a.pair_id)
select p.pair_id, coalesce(g.group_id, p.pair_id) as group_id from parallel_ing_rus p left join (select r.p, min(k.pair_id) as group_id from r join k on k.k = r.k group by r.p) g on g.p = p.pair_id""",
}
