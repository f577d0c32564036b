"""The graph facade, written logs, lakes and indexes, and file sources."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbora.functions import urls, vectors
from arbora.operators import combine, search, triples
from arbora.operators.graph import Graph
from arbora.sources import files
from arbora.streaming import cdc, windows

B = "https://e.x/"
ROWS = "subject string, predicate string, obj_type int, obj_ref string, obj_string string, obj_int64 long, obj_float64 double, obj_bool boolean, obj_timestamp long, timestamp long"


@pytest.fixture(scope="module")
def graph(spark):
    g = Graph(spark.createDataFrame([], ROWS))
    return g.execute([("create", B + "a", {"$type": "P", "age": 3, "knows": [{"@ref": B + "b"}, {"@ref": B + "c"}]}), ("create", B + "b", {"age": 4}), ("create", B + "c", {"age": 4, "ok": True}), ("create", B + "a", {}), ("delete", B + "zz", {}), ("drop", B + "a", {})])


def test_batch_reports_errors(graph):
    assert [i for i, _ in graph.errors] == [3, 4, 5]
    with pytest.raises(ValueError):
        graph.execute([("create", B + "q", {})] * 1001)
    with pytest.raises(ValueError):
        graph.create(B + "b", {})


def test_read_traverse_delete(graph):
    out = {r["subject"]: r for r in graph.get(B + "a", B + "none").collect()}
    assert out[B + "a"]["type"] == "P" and out[B + "a"]["props"]["age"] == ["3"] and out[B + "none"]["props"] is None
    keys = lambda df: [r["key"] for r in df.collect()]
    assert keys(graph.traverse(B + "a", "knows")) == [B + "b", B + "c"]
    assert keys(graph.traverse(B + "a", "knows", {"age": 4, "ok": True})) == [B + "c"] and keys(graph.traverse(B + "a", "knows", limit=1)) == [B + "b"]
    assert keys(graph.reverse_traverse(B + "c", "knows")) == [B + "a"]
    changed = graph.delete(B + "c").update(B + "b", {"age": 5})
    assert {(r["subject"], r["obj_int64"]) for r in changed.live().filter("predicate = 'age'").collect()} == {(B + "a", 3), (B + "b", 5)}
    again = graph.execute([("delete", B + "b", {}), ("create", B + "b", {"age": 9})])
    assert [(r["subject"], r["obj_int64"]) for r in again.live().filter("subject like '%/b'").collect()] == [(B + "b", 9)] and not again.errors


def test_retract_hides_pairs(spark, graph):
    gone = triples.retract(graph.rows, spark.createDataFrame([(B + "a", "age"), (B + "zz", "age")], "subject string, predicate string"), F.lit(99).cast("long"))
    assert {r["subject"] for r in triples.exists(gone).filter("predicate = 'age'").collect()} == {B + "b", B + "c"}


def test_log_is_written_and_read_by_day(spark, tmp_path):
    rows = [(f"s{k}", "p", "delete" if k == 3 else "insert", "v", "ns", k, dt.datetime(2024, 1, 1 + k)) for k in range(5)]
    spark.createDataFrame(rows, "subject string, predicate string, op string, value string, namespace string, sequence long, event_ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run resumes and writes nothing again
        cdc.write_log(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log")).withColumn("date", F.col("date").cast("string"))
    assert [r["sequence"] for r in cdc.log_between(log, "2024-01-02", "2024-01-05").orderBy("sequence").collect()] == [1, 2, 3]
    assert {r["subject"] for r in cdc.replay(log).collect()} == {"s0", "s1", "s2", "s4"}
    assert {r["op"]: r["n_events"] for r in cdc.dry_run(log).collect()} == {"insert": 4, "delete": 1}
    assert "PartitionFilters: [isnotnull(date" in cdc.log_between(spark.read.parquet(str(tmp_path / "log")), "2024-01-02", "2024-01-05")._jdf.queryExecution().toString()


def test_sink_overwrites_a_batch_that_comes_again(spark, tmp_path):
    write = cdc.latest_sink(str(tmp_path / "out"))
    for _ in range(2):
        write(spark.range(3), 7)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_compaction_rewrites_sorted_files(spark, tmp_path):
    rows = spark.range(1000).select(F.lit("n").alias("namespace"), F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("subject"), F.lit("p").alias("predicate"), F.col("id").alias("timestamp"))
    cdc.compact(rows.repartition(16), str(tmp_path / "c"), 600)
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 1000 and len(back.inputFiles()) < 16


def test_compaction_plan_over_slots_is_the_running_sum(spark):
    rows = [(k, "a" if k % 4 else "b", 1 + k * 7 % 13, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k // 3)) for k in range(300)]
    plan = {r["chunk_id"]: r["bin"] for r in cdc.compaction_plan(spark.createDataFrame(rows, "chunk_id long, namespace string, size long, created timestamp"), 50, slots=7).collect()}
    before = {"a": 0, "b": 0}
    for k, ns, size, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        assert plan[k] == before[ns] // 50
        before[ns] += size


def test_rate_limit_pieces(spark):
    rows = [("hot", 10 * k, k) for k in range(500)] + [("hot", 100_000 + 300 * k, 1000 + k) for k in range(9)] + [("b", 5, 9999)]
    want, opened, seen = {9999: True}, None, 0
    for _, ms, k in rows[:-1]:
        if opened is None or ms - opened >= 1000:
            opened, seen = ms, 0
        want[k] = seen < 3
        seen += seen < 3
    got = windows.fixed_window_limit(spark.createDataFrame(rows, "c string, ms long, id long"), "c", "ms", "id", 3, 1000)
    assert {r["id"]: r["allowed"] for r in got.collect()} == want


def test_text_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sat on the mat, the end"), (2, "Cats, sitting; the CAT"), (3, ""), (4, None), (5, "on on the on the")], "id long, t string")
    index = search.TextIndex.write(docs, "id", "t", str(tmp_path / "ix"), stem=True)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(index.phrase(["on", "the"])) == [1, 5] and ids(index.phrase(["on", "the", "on", "the"])) == [5] and ids(index.phrase(["the", "cat"])) == [1, 2]
    assert ids(index.prefix("ca")) == [1, 2] and ids(index.prefix("s")) == [1, 2] and ids(index.stemmed("cat")) == [1, 2] and ids(index.all_of(["zz"])) == []
    assert ids(index.boolean(must=["the"], should=["mat", "on"], must_not=["sat"])) == [5]
    scan = {r["id"]: round(r["score"], 9) for r in search.bm25(docs.filter("t IS NOT NULL"), "id", "t", ["the", "cat"]).collect()}
    assert {r["id"]: round(r["score"], 9) for r in index.bm25(["the", "cat"]).collect()} == scan
    assert [r["id"] for r in index.bm25(["the", "cat"], k=1, offset=1).collect()] == [sorted(scan, key=lambda k: -scan[k])[1]]


def test_sources(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres\nt1\tmovie\tA \\N b\tA\t0\t1999\t\\N\t90\tDrama\nt2\tshort\tB\tB\t0\t\\N\t\\N\t\\N\tX\n")
    assert [(r["tconst"], r["startYear"], r["endYear"]) for r in files.movie_titles(spark, str(tmp_path / "t.tsv")).collect()] == [("t1", 1999, None)]
    (tmp_path / "w.ndjson").write_text('{"word": "a", "pos": "noun"}\nnot json\n{"word": "b"}\n')
    assert [r["word"] for r in files.read_ndjson(spark, str(tmp_path / "w.ndjson"), "word string, pos string").collect()] == ["a", "b"]
    v = spark.createDataFrame([(1, "com.a.www"), (2, "org.b")], "id long, reversed_host string")
    assert [(r["src"], r["dst"]) for r in files.host_graph(v, spark.createDataFrame([(1, 2), (1, 9)], "from_id long, to_id long")).collect()] == [("www.a.com", "b.org")]
    people = spark.createDataFrame([("t1", "n1", "director"), ("t1", "n2", "self"), ("t1", "n3", "cook")], "tconst string, nconst string, category string")
    assert {r["predicate"] for r in files.credits(people, B).collect()} == {"directedBy", "starring"}
    (tmp_path / "l.txt").write_text(" one \n\n two\n")
    assert [r["line"] for r in files.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["one", "two"]


def test_lake_and_manifest(spark, tmp_path):
    rows = triples.melt(files.synthetic_rows(spark, 200), F.concat(F.lit(B), F.col("id").cast("string")), {"name": "name", "value": "value"})
    files.write_lake(rows, str(tmp_path / "lake"), 3)
    parts = files.manifest(spark, str(tmp_path / "lake")).collect()
    assert sum(r["n_triples"] for r in parts) == 400 and all(r["size"] > 0 for r in parts)
    assert triples.spo(spark.read.parquet(str(tmp_path / "lake")), B + "7", versions="latest").count() == 2


def test_supplementary_characters_hash_as_two_units(spark):
    h = 2166136261
    for unit in (0xD83D, 0xDE00):
        h = (h ^ unit) * 16777619 % 2**32
    assert spark.range(1).select(vectors.fnv1a(F.lit("\U0001f600"))).first()[0] == h


def test_offset_cursors_never_raise():
    assert combine.read_offset(combine.offset_cursor(7)) == 7 and combine.read_offset("nonsense") == 0 and combine.read_offset(None) == 0


def test_sort_keys_return_to_urls(spark):
    told = ["https://a.b.c/", "https://a.b.c:8443/x/y,z?q=1,2#h,i", "https://e.x/a?b", "https://e.x/#f"]
    df = spark.createDataFrame([(u,) for u in told], "u string")
    assert [r[0] for r in df.select(urls.key_to_url(urls.sort_key(F.col("u")))).collect()] == told


def test_postings_need_no_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "-b a b"), (2, None), (3, "..."), (4, "A b; a"), (5, "c")], "id long, t string")
    df = search.postings(docs, "id", "t")
    want = [("a", 1, 1, 3, [1]), ("a", 4, 2, 3, [0, 2]), ("b", 1, 2, 3, [0, 2]), ("b", 4, 1, 3, [1]), ("c", 5, 1, 1, [0])]
    assert sorted(map(tuple, df.collect())) == want
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    batch = pa.RecordBatch.from_arrays([pa.array([9, 1, 3, 4, 5]), pa.array([["z"], ["b", "a", "b"], [], ["a", "b", "a"], ["c"]])], names=["id", "ts"]).slice(1)
    for chunk in (1, 3, 4, 100):
        monkeypatch.setattr(search, "CHUNK", chunk)
        rows = [tuple(r.values()) for part in search._posted([batch]) for r in part.to_pylist()]
        assert sorted(rows) == want


def test_all_terms_in_one_row_each(spark, tmp_path):
    index = search.TextIndex.write(spark.createDataFrame([(1, "a"), (1, "a c"), (2, "a b")], "id long, t string"), "id", "t", str(tmp_path / "ix"))
    assert [r["id"] for r in index.all_of(["a", "b"]).collect()] == [2]
