"""Filter builders of the views: periods, categories, searches, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def period_and_category(df: DataFrame, year: Column, category: Column, first: int | None = None, last: int | None = None, wanted: str | None = None, lenient: bool = False) -> DataFrame:
    """Both bounds are needed: a single one is ignored unless ``lenient``; null years never match a period."""
    if first is not None and last is not None:
        df = df.where(year.between(first, last))
    elif lenient and (first is not None or last is not None):
        df = df.where(year >= first if first is not None else year <= last)
    return df.where(category == wanted) if wanted else df


def name_contains(c: Column, text: str | None) -> Column:
    """Case ignored; a blank search matches all, null names match nothing else."""
    return F.lit(True) if not text or not text.strip() else F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))


def any_contains(columns: list[Column], text: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return out


def on_map(lat: Column, lon: Column, category: Column, wanted: list[str], year: Column, first: int, last: int) -> Column:
    return lat.isNotNull() & lon.isNotNull() & category.isin(wanted) & year.between(first, last)


def layer_visible(eras: Column, era: int, every: int = 5) -> Column:
    """A border that belongs to the era; the last era shows every border."""
    return F.array_contains(eras, era) | F.lit(era == every)


def request_code(text: Column, source: Column, target: Column, languages: tuple[str, ...], longest: int) -> Column:
    """'ok' or the first reason for which a translation request is refused."""
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty")
        .when(F.length(text) > longest, "too_long")
        .when(~F.coalesce(source.isin(*languages), F.lit(False)) | ~F.coalesce(target.isin(*languages), F.lit(False)), "bad_lang")
        .when(source == target, "same_lang")
        .otherwise("ok")
    )


def ratio_between(a: Column, b: Column, low: float = 0.4, high: float = 2.5) -> Column:
    """Strictly between; an empty second side counts as 1."""
    r = F.length(a) / F.greatest(F.length(b), F.lit(1))
    return (r > low) & (r < high)


def ratio_at_most(a: Column, b: Column, most: float = 5.0) -> Column:
    return F.greatest(F.length(a), F.length(b)) / F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)) <= most


def both_directions(df: DataFrame, keep: list[str], a: str, b: str, lang_a: str, lang_b: str) -> DataFrame:
    """Each pair once in either direction."""
    def one(x: str, y: str, lx: str, ly: str) -> Column:
        return F.struct(F.col(x).alias("src"), F.col(y).alias("tgt"), F.lit(lx).alias("src_lang"), F.lit(ly).alias("tgt_lang"))

    return df.select(*keep, F.explode(F.array(one(a, b, lang_a, lang_b), one(b, a, lang_b, lang_a))).alias("x")).select(*keep, "x.*")
