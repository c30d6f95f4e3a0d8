"""Joins and windows that the views and builders share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key: the first by a total order (plans a group limit before the shuffle)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_per_key(df: DataFrame, keys: list[str], k: int, *order, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left join with a default; whether the table is broadcast is left to its measured size."""
    out = df.join(table, key, "left")
    return out.withColumn(value, F.coalesce(value, F.lit(default))) if default is not None else out


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: list[str], tolerance: float = 0.0, strict: bool = False) -> DataFrame:
    """Each left row with the last right row of its key at or before ``at + tolerance``.

    One shuffle and one sort: both sides are put on one time line and the last right row is
    carried forward; no pair of rows is made.
    """
    blank = [F.lit(None).cast(dict(right.dtypes)[v]).alias(v) for v in values]
    shift = F.col(at) + F.lit(tolerance) if tolerance else F.col(at)
    side = F.lit(0 if strict else 2)
    a = left.select(*keys, F.struct(*[c for c in left.columns]).alias("__row"), shift.alias("__t"), side.alias("__side"), *blank, F.lit(None).cast(dict(right.dtypes)[right_at]).alias("__at"))
    b = right.select(*keys, F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(right_at).cast(dict(a.dtypes)["__t"]).alias("__t"), F.lit(1).alias("__side"), *values, F.col(right_at).alias("__at"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side", *values).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__side") == 1, F.struct("__at", *values)), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("__last", last).where(F.col("__side") != 1).select("__row.*", F.col("__last.__at").alias(f"{right_at}_matched"), *[F.col(f"__last.{v}").alias(v) for v in values])


def disjoint_pairs(df: DataFrame, keys: list[str], position: str, matches: Column) -> DataFrame:
    """Greedy choice of adjacent pairs: of each run of candidate places the odd ones.

    ``matches`` is true at a place whose pair with the next place is a candidate.
    """
    w = Window.partitionBy(*keys).orderBy(position)
    cand = df.withColumn("__pos", F.row_number().over(w)).withColumn("__ok", matches).where("__ok")
    cand = cand.withColumn("__island", F.col("__pos") - F.row_number().over(w))
    rank = F.row_number().over(Window.partitionBy(*keys, "__island").orderBy(position))
    return cand.withColumn("__rank", rank).where("__rank % 2 = 1").drop("__pos", "__ok", "__island", "__rank")


def zip_by_position(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """n-th row of the left with n-th row of the right side, within each key."""
    a = left.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(left_order)))
    b = right.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(right_order)))
    return a.join(b, [*keys, "n"])


def merged(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the first table, and those of the second with other keys."""
    return primary.unionByName(secondary.join(primary.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def overlay(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of the patch where it has a value."""
    p = patch.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = base.join(p, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    return out.drop(*[f"__{c}" for c in columns])


def era_of(year: Column, eras, closed: bool) -> Column:
    """Label of the first era that holds the year; a null year counts as 0."""
    y = F.coalesce(year, F.lit(0))
    out = F.lit(None).cast("string")
    for label, first, last in reversed(eras):
        out = F.when((y >= first) & ((y <= last) if closed else (y < last)), F.lit(label)).otherwise(out)
    return out


def in_eras(df: DataFrame, year: Column, eras) -> DataFrame:
    """A row for each closed era that holds the year (eras may overlap); the dimension is a literal."""
    y = F.coalesce(year, F.lit(0))
    found = F.filter(F.array(*[F.struct(F.lit(i).alias("era"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a, b in eras]), lambda e: (y >= e["a"]) & (y <= e["b"]))
    return df.withColumn("__e", F.explode(found)).withColumn("era", F.col("__e.era")).drop("__e")


def streak_stop(df: DataFrame, keys: list[str], position: str, empty: Column, n: int) -> DataFrame:
    """Rows before the ``n``-th empty one in a row."""
    w = Window.partitionBy(*keys).orderBy(position)
    d = df.withColumn("__e", F.when(empty, 1).otherwise(0)).withColumn("__g", F.sum(F.when(empty, 0).otherwise(1)).over(w))
    d = d.withColumn("__s", F.sum("__e").over(Window.partitionBy(*keys, "__g").orderBy(position)))
    stop = F.max(F.when(F.col("__s") >= n, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("__x", stop).where("__x = 0").drop("__e", "__g", "__s", "__x")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hashed_rank_split(df: DataFrame, key: str, seed: int, dev: int, test: int, least: int = 100) -> DataFrame:
    """train, dev and test by the rank of a hash; each held-out part has at least ``least`` rows.

    Ranks come from counts of 4096 hash ranges and a rank within each range, so no task sorts all rows.
    """
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    d = df.withColumn("__h", h).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    counts = d.groupBy("__b").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 4096 rows
    total = counts.agg(F.sum("__c").alias("__n"))
    r = d.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))).join(F.broadcast(before.select("__b", "__before")), "__b").crossJoin(F.broadcast(total))
    rank = F.col("__r") + F.col("__before")
    n_test = F.greatest(F.lit(least), F.floor(F.col("__n") * test / 100))
    n_dev = F.greatest(F.lit(least), F.floor(F.col("__n") * dev / 100))
    split = F.when(rank <= n_test, "test").when(rank <= n_test + n_dev, "dev").otherwise("train")
    return r.withColumn("split", split).drop("__h", "__b", "__r", "__before", "__n", "__c")
