"""Catalog pages, fallback chains, paged listings, and the seams for what is outside Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import strings as S


def catalog_rows(html: Column) -> Column:
    """(title, url, file_size, download_count, upload_date) of each row of a listing table."""
    def one(row: Column) -> Column:
        return F.struct(
            S.strip(F.regexp_extract(row, "(?is)<a[^>]*>(.*?)</a>", 1)).alias("title"),
            F.regexp_extract(row, "(?is)<a[^>]*href=[\"']([^\"']+)[\"']", 1).alias("url"),
            S.strip(F.regexp_extract(row, "(?i)([\\d.,]+\\s*(?:Кб|Мб|Гб|KB|MB|GB))", 1)).alias("file_size"),
            S.first_int(F.regexp_extract(row, "(?i)(\\d+)\\s*(?:загруз|скач|download)", 1)).cast("int").alias("download_count"),
            F.regexp_extract(row, "(\\d{2}\\.\\d{2}\\.\\d{4})", 1).alias("upload_date"),
        )

    return F.filter(F.transform(F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), 1), one), lambda r: r["url"] != "")


def first_long_enough(attempts: DataFrame, key: str, order: str, text: str, threshold: int) -> DataFrame:
    """The first attempt of each key whose text is longer than the threshold."""
    return attempts.where(F.length(text) > threshold).groupBy(key).agg(F.min_by(text, order).alias(text))


def pages_until_short(pages: DataFrame, key: str, number: str, text: str, least: int = 300) -> DataFrame:
    """Each key's pages, joined, up to the first one with a short text."""
    w = Window.partitionBy(key).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    short = F.max(F.when(F.coalesce(F.length(text), F.lit(0)) < least, 1).otherwise(0)).over(w)
    kept = pages.withColumn("__short", short).where("__short = 0")
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, text))), lambda x: x[text]), "\n").alias(text))


def text_layer(pages: DataFrame, key: str, number: str, text: str, first: int = 10, least: float = 40.0) -> DataFrame:
    """Whether the mean length of the first pages tells of a text layer."""
    return pages.where(F.col(number) < first).groupBy(key).agg(F.avg(F.coalesce(F.length(text), F.lit(0))).alias("mean_chars")).withColumn("has_text", F.col("mean_chars") >= least)


def cursor_pages(pages: DataFrame, key: str, number: str, items: str, stop_after: int = 2) -> DataFrame:
    """Landed pages of a listing up to ``stop_after`` empty ones in a row."""
    w = Window.partitionBy(key).orderBy(number)
    empty = F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, 1).otherwise(0)
    marked = pages.withColumn("__e", empty).withColumn("__run", F.sum(F.when(F.col("__e") == 0, 1).otherwise(0)).over(w))
    streak = F.sum("__e").over(Window.partitionBy(key, "__run").orderBy(number))
    stopped = F.max(F.when(F.col("__streak") >= stop_after, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("__streak", streak).withColumn("__stop", stopped).where("__stop = 0").drop("__e", "__run", "__streak", "__stop")


def external(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Seam for what runs outside Spark (page recognition, model calls): ``fn`` maps Arrow batches."""
    return df.mapInArrow(fn, schema)
