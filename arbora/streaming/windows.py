"""Event-time windows, for streams and tables alike, and a rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, width: str, slide: str | None = None, by: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` by window; ``late`` sets a watermark on a stream."""
    rows = events if late is None else events.withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = rows.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, user: str, gap: str) -> DataFrame:
    """Sessions that a silence of ``gap`` ends."""
    out = events.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return out.select(user, F.col("w.start").alias("session_start"), "n")


def hit_rates(events: DataFrame, ts: str, hit, width: str = "5 minutes") -> DataFrame:
    return events.groupBy(F.window(ts, width).alias("w")).agg(F.avg(hit.cast("double")).alias("hit_rate")).select(F.col("w.start").alias("window_start"), "hit_rate")


def fixed_window_limit(events: DataFrame, client: str, ts_ms: str, key: str, limit: int, window_ms: int) -> DataFrame:
    """(key, allowed): at most ``limit`` events of a client in a window that its first event opens.

    A silence of ``window_ms`` always ends a window, so a client's events are cut there and the
    pieces are folded apart; a task streams its pieces sorted and holds three numbers of state.
    """
    order = Window.partitionBy(client).orderBy(ts_ms, key)
    gap = F.coalesce((F.col(ts_ms) - F.lag(ts_ms).over(order) >= window_ms).cast("long"), F.lit(0).cast("long"))
    pieces = events.select(client, ts_ms, key).withColumn("_gap", gap).withColumn("_piece", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = pieces.select(F.xxhash64(client, "_piece").alias("_h"), client, "_piece", ts_ms, key)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, opened, seen = None, 0, 0
        for pdf in batches:
            allowed = []
            for c, piece, ms in zip(pdf[client], pdf["_piece"], pdf[ts_ms], strict=True):
                if (c, piece) != at or ms - opened >= window_ms:
                    at, opened, seen = (c, piece), ms, 0
                allowed.append(seen < limit)
                seen += seen < limit
            yield pd.DataFrame({key: pdf[key], "allowed": allowed})

    spread = pieces.repartition("_h").sortWithinPartitions("_h", client, "_piece", ts_ms, key)
    return spread.mapInPandas(fold, f"{key} {events.schema[key].dataType.simpleString()}, allowed boolean")


def running_total(events: DataFrame, by: str, ts: str, value: str) -> DataFrame:
    order = Window.partitionBy(by).orderBy(ts, value).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("running", F.sum(value).over(order))
