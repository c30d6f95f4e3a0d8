"""Stateful operators: token buckets per key, debouncing, windows over event time, incremental append."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.profile import BUCKET_CAPACITY, BUCKET_PER_SECOND


def take(tokens: float, last: float | None, now: float, capacity: float = BUCKET_CAPACITY, rate: float = BUCKET_PER_SECOND) -> tuple[float, bool]:
    """Tokens left and whether the request is allowed."""
    tokens = capacity if last is None else min(capacity, tokens + max(0.0, now - last) * rate)
    return (tokens - 1.0, True) if tokens >= 1.0 else (tokens, False)


def allow(events: DataFrame, key: str, at: str, event: str, capacity: float = BUCKET_CAPACITY, rate: float = BUCKET_PER_SECOND) -> DataFrame:
    """(key, event, allowed) over a batch: each key's requests in order of time.

    Partitions are sorted and read as streams, with one bucket in memory, so a key with a
    large share of all requests needs no more room than any other.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_key, tokens, last = object(), capacity, None
        for pdf in batches:
            out = []
            for k, now in zip(pdf[key], pdf[at]):
                if k != now_key:
                    now_key, tokens, last = k, capacity, None
                tokens, ok = take(tokens, last, now, capacity, rate)
                last = now
                out.append(ok)
            yield pd.DataFrame({key: pdf[key], event: pdf[event], "allowed": out})

    kinds = dict(events.dtypes)
    ordered = events.select(key, at, event).repartition(key).sortWithinPartitions(key, at, event)
    return ordered.mapInPandas(run, f"{key} {kinds[key]}, {event} {kinds[event]}, allowed boolean")


def allow_stream(events: DataFrame, key: str, at: str, event: str, capacity: float = BUCKET_CAPACITY, rate: float = BUCKET_PER_SECOND) -> DataFrame:
    """The same over a stream; the state of a key is its tokens and the time of its last request."""
    kinds = dict(events.dtypes)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        pdf = pd.concat(list(batches)).sort_values([at, event])
        out = []
        for now in pdf[at]:
            tokens, ok = take(tokens, last, now, capacity, rate)
            last = float(now)
            out.append(ok)
        state.update((tokens, last))
        yield pd.DataFrame({key: pdf[key], event: pdf[event], "allowed": out})

    return events.select(key, at, event).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {event} {kinds[event]}, allowed boolean", "tokens double, last double", "append", "NoTimeout")


def debounce(events: DataFrame, key: str, at: str, tie: str, gap: float) -> DataFrame:
    """Events that no later one of the same key follows within ``gap`` seconds."""
    nxt = F.lead(at).over(Window.partitionBy(key).orderBy(at, tie))
    return events.withColumn("__n", nxt).where(F.col("__n").isNull() | (F.col("__n") - F.col(at) > gap)).drop("__n")


def windowed(events: DataFrame, at: str, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of event-time windows; late rows beyond the watermark are dropped in a stream."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    base = events.withWatermark(at, late) if events.isStreaming else events
    return base.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def not_done(listing: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: what isn't in the table of finished keys."""
    return listing.join(done.select(key).distinct(), key, "left_anti")


def append_valid(stream: DataFrame, path: str, checkpoint: str):
    """Suggestions as they come, the valid ones appended as JSON lines."""
    from lexloom.sources.sinks import valid_suggestions

    return valid_suggestions(stream).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
