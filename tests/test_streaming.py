import datetime as dt

from pyspark.sql import functions as F

from arbora.operators import combine, triples
from arbora.streaming import cdc, windows

SCHEMA = "shard_id string, sequence long, op string, subject string, predicate string, value string, event_ts timestamp"


def event(seq, op="insert", value="v", subject="s"):
    return ("a", seq, op, subject, "p", value, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seq))


def test_stream_keeps_sequence(spark, tmp_path):
    for k, rows in enumerate(([event(1), event(2)], [event(2), event(3)], [event(1)])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = cdc.in_sequence(stream).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    kept = [r["sequence"] for r in spark.sql("SELECT sequence FROM kept ORDER BY sequence").collect()]
    assert len(kept) == len(set(kept)) and max(kept) == 3


def test_replay_hides_deletes(spark):
    events = spark.createDataFrame([event(1, value="x"), event(2, "update", "y"), event(3, "delete")], SCHEMA)
    assert cdc.replay(events).count() == 0
    assert cdc.replay(events, dt.datetime(2024, 1, 1, 0, 0, 2)).first()["value"] == "y"


def test_rate_limit(spark):
    events = spark.createDataFrame([("c", 0, 1), ("c", 10, 2), ("c", 20, 3), ("c", 1000, 4)], "client string, ms long, id long")
    out = windows.fixed_window_limit(events, "client", "ms", "id", 2, 1000)
    assert [r["allowed"] for r in out.orderBy("id").collect()] == [True, True, False, True]


def test_ties_survive_and_tombstones_hide(spark):
    t = spark.createDataFrame([("s", "p", 5, "a", 1), ("s", "p", 5, "b", 1), ("s", "q", 5, "c", 1), ("s", "q", 0, None, 2)], "subject string, predicate string, obj_type int, obj_string string, timestamp long")
    assert {r["obj_string"] for r in triples.alive(t).collect()} == {"a", "b"}


def test_quorum_strict(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "id long, v string")
    assert [tuple(r) for r in combine.quorum(rows, "id", 2).select("id", "v", "votes").collect()] == [(1, "a", 2)]


def test_window_on_stream_has_watermark(spark):
    stream = spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    assert windows.windowed(stream, "ts", "5 minutes", late="10 minutes").isStreaming
