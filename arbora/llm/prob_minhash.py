"""Near-duplicates by ProbMinHash.

A text is its set of five-word shingles (lower-case words; one shingle of all words
if there are fewer).  Each shingle sends exponential arrivals at the rate of its weight; an
arrival falls on one of ``REGISTERS`` registers, the earliest one owns it,
and a shingle stops once its next arrival would come later than every register's.  Two texts
own a register alike with the probability Jaccard of their weights.  Bands of registers
give candidates; those are verified by the exact Jaccard of their shingle sets.  All weights
are 1, however often a shingle is repeated, so that registers estimate what is verified.
``BANDS`` and ``ROWS`` suit thresholds of 0.8 or more; under a lower one, bands miss more pairs.

Only distinct texts are compared.  In each bucket every text is verified against one
leader, the first of the bucket in one of ``ORDERS`` fixed orders, so that a large group has few leaders; linked texts form components.  Texts that share buckets,
directly or through others, form clusters; where a cluster holds several components, those
texts that are outside its greatest component meet the whole cluster in blocks, bounded by texts
and shingles.  Inside a block every pair of two components that shares a band is verified, and
links that join components are sent on.  No group is expanded into all its pairs as rows; every
candidate pair is verified or already joined.

Defined cases: null texts and texts without words are classes of their own; equal texts are
one class however short; a class is named by its smallest doc_id; repeated rows are copies;
an empty table gives an empty result; other columns pass through ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.scratch import materialize, settings

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
#: Orders that leaders are chosen by: a text meets about so many, however many buckets it is in.
ORDERS = 2
#: Bytes of text that are hashed at once.
CHUNK = 2_000_000
#: Texts, and their shingles, on each side of a block on average at most; a block is one task's work.
BLOCK, BLOCK_SHINGLES = 512, 300_000
#: Spark's runtime Bloom filter in front of the join of texts with candidates: 4 MB at any size, 8 bits a
#: candidate up to four million of them.  With more, more texts pass it; the join behind it is exact.
BLOOM = {
    "runtime.bloomFilter.enabled": "true", "runtimeFilter.number.threshold": "1",
    "runtime.bloomFilter.expectedNumItems": "4000000", "runtime.bloomFilter.numBits": str(1 << 25),
    "runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "runtime.bloomFilter.creationSideThreshold": "1t",
}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0x9E3779B97F4A7C15
_B = np.uint64(_STEP)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _times(k: int) -> np.uint64:
    return np.uint64(k * _STEP % 2**64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = 0x5851F42D4C957F2D
    both = []
    for b in (base, pow(base, -1, 2**64)):
        row = np.full(n, b, np.uint64)
        row[0] = 1
        both.append(np.cumprod(row, dtype=np.uint64))
    return both[0], both[1]


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each."""
    blob = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    up, down = _powers(len(blob) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((blob.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    space = _SPACE[blob]
    before = np.concatenate(([True], space[:-1]))
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(space & ~before)
    hashes = _mix((sums[ends] - sums[starts]) * down[starts])
    edges = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, edges), prepend=0)


def shingles(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingle hashes of each text, sorted, and how often each occurs."""
    hashes, lengths = _word_hashes(texts)
    parts = [_mix(hashes + _times(k + 1)) for k in range(SHINGLE)]
    whole = parts[0][: max(0, len(hashes) - SHINGLE + 1)].copy()
    for k in range(1, SHINGLE):
        whole += parts[k][k : len(whole) + k]
    whole = _mix(whole)
    out, at = [], 0
    for n in lengths.tolist():
        if n >= SHINGLE:
            out.append(np.unique(whole[at : at + n - SHINGLE + 1], return_counts=True))
        elif n:
            few = sum(int(parts[k][at + k]) for k in range(n)) + n
            out.append((_mix(np.array([few % 2**64], np.uint64)), np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        at += n
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """The owner of each register of each set; 0 where a set is empty."""
    owner = np.zeros((len(sets), m), np.uint64)
    if not sets:
        return owner
    e = np.concatenate([s for s, _ in sets])
    rate = 1 + np.log(np.maximum(1, np.concatenate([c for _, c in sets])))
    d = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
    first = np.full((len(sets), m), np.inf)
    latest = np.full(len(sets), np.inf)
    flat_first, flat_owner = first.ravel(), owner.ravel()
    t, k = np.zeros(len(e)), 0
    while len(e):
        k += 1
        drawn = _mix(e + _times(k))
        t = t - np.log(((drawn >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        live = t < latest[d]
        e, rate, d, t, drawn = e[live], rate[live], d[live], t[live], drawn[live]
        at = d * m + (_mix(drawn) % np.uint64(m)).astype(np.int64)
        np.minimum.at(flat_first, at, t)
        won = flat_first[at] == t
        flat_owner[at[won]] = e[won]
        if len(d):
            some = np.flatnonzero(np.bincount(d, minlength=len(sets))) if len(d) < len(sets) else np.arange(len(sets))
            latest[some] = first[some].max(1)
    return owner


def bands(owner: np.ndarray) -> np.ndarray:
    parts = owner.reshape(len(owner), BANDS, ROWS)
    value = np.broadcast_to((np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _M1, parts.shape[:2]).copy()
    for k in range(ROWS):
        value = _mix(value * _B + parts[:, :, k])
    return value.view(np.int64)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    held, size, begin = [], 0, 0
    for i, x in enumerate(batch.column("blob")):
        held.append(x.as_py())
        size += len(held[-1])
        if size >= CHUNK:
            yield begin, held
            held, size, begin = [], 0, i + 1
    if held:
        yield begin, held


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, texts in _chunks(batch):
            sets = shingles(texts)
            owner = signatures([(s, np.ones(len(s), np.int64)) for s, _ in sets])
            rows = batch.slice(begin, len(texts))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(bands(owner).ravel()))
            short = pa.array([x.tobytes() for x in (owner & np.uint64(0xFFFFFFFF)).astype(np.uint32)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("node"), pa.array([len(s) for s, _ in sets], pa.int32()), values, short],
                names=["doc_id", "node", "n", "bands", "owner"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, texts in _chunks(batch):
            sets = [s.view(np.int64) for s, _ in shingles(texts)]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.slice(begin, len(texts)).column("node"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], names=["node", "set"])


def node_of(text: Column) -> Column:
    """Name of a distinct text."""
    return F.unhex(F.md5(text.cast("binary")))


def _blobs(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), node_of(t).alias("node"), t.cast("binary").alias("blob"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the Jaccard; sets hold each text's distinct shingles."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    met = F.size(F.array_intersect("sa", "sb"))
    return two.select("a", "b", met.alias("met"), (F.size("sa") + F.size("sb")).alias("both")).filter(F.col("met") >= threshold * (F.col("both") - F.col("met"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of an edge: the least node of its component.

    In each round every node goes to the least of itself and its neighbours, and on to where that
    one goes; the edges between the nodes that are left are the next round's, until none are.
    The rounds shrink, so that their joins together are a few times the edges.
    """
    pairs = lambda e, a, b: e.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()
    left, rounds = materialize(pairs(edges, "a", "b"), "edges"), []
    while True:
        near = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("near"))
        onward = near.select(F.col("node").alias("near"), F.col("near").alias("label"))
        rounds.append(materialize(near.join(onward, "near").select("node", "label"), "labels"))
        to = lambda name: rounds[-1].select(F.col("node").alias(name), F.col("label").alias(f"l{name}"))
        left = materialize(pairs(left.join(to("a"), "a").join(to("b"), "b"), "la", "lb"), "edges")
        if left.isEmpty():
            break
    labels = rounds.pop()
    while rounds:
        labels = _onward(rounds.pop(), labels)
    return materialize(labels, "labels")


def _onward(labels: DataFrame, after: DataFrame) -> DataFrame:
    """Labels followed through those of a later round."""
    return labels.join(after.select(F.col("node").alias("label"), F.col("label").alias("last")), "label", "left").select("node", F.coalesce("last", "label").alias("label"))


def _extended(labels: DataFrame, more: DataFrame) -> DataFrame:
    """The labels after further links, between components or texts without one."""
    of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"l{name}"))
    met = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
    after = components(met.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    return materialize(_onward(labels, after).unionByName(after.join(labels, "node", "left_anti").select("node", "label")), "labels")


def _across(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of a block that join components not joined yet: each left text against the right ones.

    A text of both sides meets its partners from one of the two directions only.  The shingles of
    one text are marked, and those of all its candidates are looked up at once.
    """
    left, right = np.flatnonzero(pdf["is_left"]), np.flatnonzero(~pdf["is_left"])
    names, outside = pdf["node"].tolist(), pdf["outside"].to_numpy()
    place = pd.factorize(pdf["node"], sort=True)[0]
    part, n = pd.factorize(pdf["label"])[0], pdf["n"].to_numpy()
    keys = np.frombuffer(b"".join(pdf["owner"]), np.uint32).reshape(len(pdf), BANDS, ROWS)
    ids = np.unique(np.concatenate(pdf["set"].to_numpy()), return_inverse=True)[1]
    sets = np.split(ids, np.cumsum(n)[:-1])
    marked = np.zeros(len(ids) + 1, bool)
    links = []
    for i in left.tolist():
        sized = np.minimum(n[right], n[i]) >= threshold * np.maximum(n[right], n[i])
        rows = right[sized & (part[right] != part[i]) & (~outside[right] | (place[right] > place[i]))]
        rows = rows[(keys[rows] == keys[i]).all(2).any(1)]
        if not len(rows):
            continue
        marked[sets[i]] = True
        met = np.add.reduceat(marked[np.concatenate([sets[j] for j in rows])].astype(np.int64), np.concatenate(([0], np.cumsum(n[rows])[:-1])))
        marked[sets[i]] = False
        for j in rows[met >= threshold * (n[rows] + n[i] - met)].tolist():
            if part[i] != part[j]:
                part[part == part[j]] = part[i]
                links.append((min(names[i], names[j]), max(names[i], names[j])))
    return pd.DataFrame(links, columns=["a", "b"])


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node, n (shingles), bands, owner (registers) of each row."""
    return _blobs(docs, key, text).mapInArrow(_sign, _shape(docs, key))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node, class_id, class_size: a row per document."""
    rows = materialize(signed(docs, key, text), "signatures")
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "texts")
    member = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    leaders = member.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.pmod("bucket", F.lit(ORDERS))), "node", "n")).alias("lead"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    leaders = materialize(leaders.select("bucket", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n")), "leaders")
    star = member.join(leaders, "bucket").filter(F.col("node") != F.col("lead"))
    sized = F.least("n", "lead_n") >= threshold * F.greatest("n", "lead_n")
    star = materialize(star.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"), sized.alias("sized")).distinct(), "pairs")
    clusters = components(star.select("a", "b"))
    wanted = materialize(clusters.join(nodes.select("node", "doc_id", "n"), "node").select("node", "doc_id", "n"), "wanted")
    sets = _candidates(_blobs(docs, key, text), wanted).mapInArrow(_sets, "node binary, set array<long>")
    with settings(docs.sparkSession, {f"spark.sql.optimizer.{k}": v for k, v in BLOOM.items()}):
        sets = materialize(sets, "sets").dropDuplicates(["node"])
    edges = materialize(_verified(star.filter("sized").select("a", "b"), sets, threshold), "links")
    labels = components(edges)
    more = materialize(_rest(clusters, labels, nodes, rows, sets, threshold), "links")
    if not more.isEmpty():
        labels = _extended(labels, more)
    return _named(rows, labels)


def _shape(docs: DataFrame, key: str) -> str:
    return f"doc_id {docs.schema[key].dataType.simpleString()}, node binary, n int, bands array<long>, owner binary"


def _candidates(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of candidates.  Spark filters texts ahead of a join only where the other side has a predicate, which n > 0 is."""
    return blobs.join(wanted.filter("n > 0"), ["doc_id", "node"], "left_semi")


def _rest(clusters: DataFrame, labels: DataFrame, nodes: DataFrame, signed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links inside clusters of texts that share buckets, between components that have none yet."""
    sized = clusters.select("node", F.col("label").alias("cluster")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sized = materialize(sized.join(nodes.select("node", "n"), "node"), "sized")
    parts = sized.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    split = parts.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("parts"), F.max(F.struct("members", "label")).alias("top"), F.sum("members").alias("members"), F.sum("shingles").alias("shingles"),
        F.max_by("shingles", F.struct("members", "label")).alias("top_shingles"),
    ).filter("parts > 1 AND members > 2")
    cut = lambda members, shingles: F.ceil(F.greatest(members / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    split = split.select(
        "cluster", F.col("top.label").alias("top"), cut(F.col("members"), F.col("shingles")).alias("blocks"),
        cut(F.col("members") - F.col("top.members"), F.col("shingles") - F.col("top_shingles")).alias("left_blocks"),
    )
    inside = sized.join(materialize(split, "split"), "cluster").withColumn("outside", F.col("label") != F.col("top"))
    owners = signed.join(nodes.select("node", "doc_id"), ["node", "doc_id"], "left_semi").select("node", "owner").dropDuplicates(["node"])
    rows = inside.join(owners, "node").join(sets, "node")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = lambda c: F.array(F.pmod(F.xxhash64("node"), F.col(c)).cast("int"))
    shown = ["cluster", "is_left", "b1", "b2", "node", "n", "label", "outside", "owner", "set"]
    rights = rows.withColumn("is_left", F.lit(False)).withColumn("b1", F.explode(upto("left_blocks"))).withColumn("b2", F.explode(own("blocks")))
    lefts = rows.filter("outside").withColumn("is_left", F.lit(True)).withColumn("b1", F.explode(own("left_blocks"))).withColumn("b2", F.explode(upto("blocks")))
    met = rights.select(shown).unionByName(lefts.select(shown)).groupBy("cluster", "b1", "b2")
    return met.applyInPandas(lambda pdf: _across(pdf, threshold), "a binary, b binary").distinct()


def _named(signed: DataFrame, labels: DataFrame) -> DataFrame:
    root = signed.select("doc_id", "node", "n").join(labels, "node", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("label", "node")))
    root = materialize(root.select("doc_id", "node", "root"), "roots")
    groups = materialize(root.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")).filter("class_size > 1"), "classes")
    return root.join(groups, "root", "left").select("doc_id", "node", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document that names its class, once, with its columns; documents in no class stay."""
    found = materialize(classes(docs, key, text), "found")
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) | F.col("doc_id").isNull())
    again = materialize(stays.filter("class_size > 1").groupBy("doc_id").count().filter("count > 1"), "again")
    node = node_of(F.coalesce(docs[text], F.lit("")))
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("pm_id"), F.col("node").alias("pm_gone")).distinct()
    kept = docs.join(gone, (docs[key] == gone["pm_id"]) & (node == gone["pm_gone"]), "left_anti")
    if not again.isEmpty():  # rows that repeat an id
        ids = again.select(F.col("doc_id").alias("pm_id"))
        same = kept[key] == ids["pm_id"]
        kept = kept.join(ids, same, "left_anti").unionByName(kept.join(ids, same, "left_semi").dropDuplicates([key]))
    return kept


def op9_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id", "class_size")
