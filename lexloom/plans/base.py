"""How the plan modules register their queries, and SQL text that mirrors the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.functions import profile as P


class Catalogue:
    """Queries by name and, where there is one, the SQL that gives the same rows."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit(s: str) -> str:
    """An SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def s_sub(e: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({e}, {lit(pattern)}, {lit(to)}, 'g')"


def s_strip(e: str) -> str:
    return s_sub(e, f"^[{P.WS}\\n]+|[{P.WS}\\n]+$")


def s_squeeze(e: str) -> str:
    return s_strip(s_sub(e, f"[{P.WS}\\n]+", " "))


def s_replace(e: str, pairs) -> str:
    for old, new in pairs:
        e = f"replace({e}, {lit(old)}, {lit(new)})"
    return e
