"""Change events: ordered intake, the log, replay to a point in time, compaction plans.

Events: shard_id, sequence, op (insert, update, delete), subject, predicate, value, event_ts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def log_between(log: DataFrame, start: str, end: str) -> DataFrame:
    """Events of the days from ``start`` up to before ``end``: folders of the log's ``date``, the others are not read."""
    return log.filter((F.col("date") >= start) & (F.col("date") < end))


def to_replay(events: DataFrame, until: object | None = None, after: int | None = None, include_deletes: bool = True) -> DataFrame:
    """Events for a handler, in order: up to a time, after the sequence that a stopped run reached, with or without deletes."""
    rows = events if until is None else events.filter(F.col("event_ts") <= F.lit(until))
    rows = rows if after is None else rows.filter(F.col("sequence") > after)
    return rows if include_deletes else rows.filter("op != 'delete'")


def dry_run(events: DataFrame) -> DataFrame:
    """What a replay would do: events by op, first and last time and sequence."""
    return events.groupBy("op").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"), F.max("sequence").alias("last_sequence"))


def replay(events: DataFrame, until: object | None = None) -> DataFrame:
    """State after the events up to a time: the last event of each (subject, predicate), deletes gone."""
    rows = to_replay(events, until)
    last = rows.groupBy("subject", "predicate").agg(F.max_by(F.struct("op", "value", "event_ts"), F.struct("event_ts", "sequence")).alias("e"))
    return last.select("subject", "predicate", "e.*").filter("op != 'delete'").drop("op")


def backups(events: DataFrame) -> DataFrame:
    """Events by day: what a restore can choose from."""
    return events.groupBy(F.to_date("event_ts").alias("day")).agg(F.count(F.lit(1)).alias("n_events"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))


def compaction_plan(chunks: DataFrame, target: int, slots: int = 64) -> DataFrame:
    """Chunks (namespace, chunk_id, size, created) with the output file that each goes to, oldest first.

    The running size is formed in slots of time: sums of the slots before, and a running sum inside
    each, so that a namespace with most of the chunks is not one task's work.
    """
    edges = chunks.select(F.min("created").alias("lo"), F.max("created").alias("hi"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    share = (us("created") - us("lo")) / F.greatest(us("hi") - us("lo"), F.lit(1))
    placed = chunks.join(F.broadcast(edges)).withColumn("slot", F.floor(share * slots).cast("int")).drop("lo", "hi")  # edges is one row
    sums = placed.groupBy("namespace", "slot").agg(F.sum("size").alias("slot_size"))
    earlier = Window.partitionBy("namespace").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("namespace", "slot", F.coalesce(F.sum("slot_size").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("namespace", "slot").orderBy("created", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("earlier") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return placed.join(sums, ["namespace", "slot"]).withColumn("bin", F.floor(before / target).cast("long")).drop("slot", "earlier")


def merge_bins(plan: DataFrame, least: int = 2) -> DataFrame:
    """(namespace, bin, chunks, size) of the output files that at least ``least`` chunks go to."""
    return plan.groupBy("namespace", "bin").agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("size")).filter(F.col("chunks") >= least)


def compact(triples: DataFrame, path: str, rows_per_file: int = 50_000) -> None:
    """Rewrite small files as few sorted ones; row-group statistics then skip by subject."""
    sorted_rows = triples.repartitionByRange("namespace", "subject").sortWithinPartitions("namespace", "subject", "predicate", "timestamp")
    sorted_rows.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").option("parquet.bloom.filter.enabled#subject", "true").mode("overwrite").parquet(path)


def _gate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else -1
    for pdf in batches:
        pdf = pdf.sort_values("sequence", kind="stable")
        fresh = pdf[(pdf["sequence"] > last) & ~pdf["sequence"].duplicated()]
        if len(fresh):
            last = int(fresh["sequence"].iloc[-1])
            yield fresh
    state.update((last,))


def in_sequence(events: DataFrame) -> DataFrame:
    """A stream's events of each shard in rising sequence; what comes again or too late is left out."""
    return events.groupBy("shard_id").applyInPandasWithState(_gate, events.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def write_log(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append a stream to the log, by namespace and day; op is kept, so deletes replay as deletes."""
    dated = events.withColumn("date", F.date_format("event_ts", "yyyy-MM-dd"))
    return dated.writeStream.partitionBy("namespace", "date").format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def latest_sink(path: str):
    """foreachBatch function: a batch's deltas in a folder of its own, overwritten if it is run again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
