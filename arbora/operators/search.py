"""Full text with BM25, nearest vectors, places, and their fusion."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import geo
from arbora.sources.files import dealt

K1, B = 1.2, 0.75
RRF_K = 60


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def sanitize(query: str) -> str:
    """A query without comments, mark-up and unbalanced quotes; 1000 characters and 100 tokens at most."""
    q = re.sub(r"--.*|/\*.*?\*/|<[^>]*>|[\x00'{};\[\]^]", " ", query[:1000])
    if q.count('"') % 2:
        q = q.replace('"', " ")
    return " ".join(q.split()[:100])


#: Settings of a build: bytes of the table that a segment is made of, and documents that Python gets at once.
BUILD = {"spark.sql.files.maxPartitionBytes": "32m", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: Tokens that are grouped at once; bounds memory, not results.
CHUNK = 2_000_000


def _grouped(keys: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
    """Postings of some documents, by token: a stable sort of token numbers leaves documents and positions in order."""
    sizes = np.diff(lists.offsets.to_numpy())
    words = lists.flatten().dictionary_encode()
    codes = words.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    doc = np.repeat(np.arange(len(sizes)), sizes)[order]
    at = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
    code = codes[order]
    first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))))
    ends = np.append(first, len(codes)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [words.dictionary.take(pa.array(code[first])), keys.take(pa.array(doc[first])), pa.array(np.diff(ends)), pa.array(sizes[doc[first]].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))],
        names=["token", "key", "tf", "dl", "at"],
    )


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, begin = batch.column(1).offsets.to_numpy(), 0
        while begin < len(batch):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + CHUNK, "right")) - 1)
            if ends[end] > ends[begin]:
                yield _grouped(batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin))
            begin = end


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, tf, dl, at): a row per document and token with its positions; counted where the document lies, without a shuffle."""
    listed = docs.filter(F.col(text).isNotNull()).select(key, F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "").alias("ts"))
    rows = listed.mapInArrow(_posted, f"token string, key {docs.schema[key].dataType.simpleString()}, tf int, dl int, at array<int>")
    return rows.withColumnRenamed("key", key)


class TextIndex:
    """An inverted index written as Parquet: segments of postings, each sorted by token, and the table's totals.

    A segment holds the documents of one part of the table, so that a build shuffles nothing and its work
    grows with the table.  A query reads the pages of its own tokens in each; Parquet statistics skip the rest.
    """

    def __init__(self, spark, path: str, key: str):
        self.key = key
        self.rows = spark.read.parquet(f"{path}/postings")
        self.totals = spark.read.parquet(f"{path}/totals")

    @classmethod
    def write(cls, docs: DataFrame, key: str, text: str, path: str, stem: bool = False) -> TextIndex:
        """Build and open an index.  Every index answers ``stemmed``, with ``stem`` or without: a stem begins its tokens, so no column is kept for it."""
        spark = docs.sparkSession
        before = {name: spark.conf.get(name, None) for name in BUILD}
        try:
            for name, value in BUILD.items():
                spark.conf.set(name, value)
            postings(dealt(docs.select(key, text)), key, text).sortWithinPartitions("token", key).write.mode("overwrite").parquet(f"{path}/postings")
        finally:
            for name, value in before.items():
                spark.conf.unset(name) if value is None else spark.conf.set(name, value)
        length = spark.read.parquet(f"{path}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("length"))
        docs.agg(F.count(F.col(text)).alias("n")).join(F.broadcast(length)).write.mode("overwrite").parquet(f"{path}/totals")  # one row each
        return cls(spark, path, key)

    def _of(self, terms: list[str]) -> DataFrame:
        return self.rows.filter(F.col("token").isin(terms))

    def bm25(self, terms: list[str], k: int | None = None, offset: int = 0) -> DataFrame:
        """(key, score) of documents with any term, best first if ``k`` is given."""
        found = self._of(terms)
        df = found.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        scored = found.join(F.broadcast(df), "token").join(F.broadcast(self.totals))  # a row per term, and one row
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") * F.col("n") / F.col("length")))
        out = scored.groupBy(self.key).agg(F.sum(idf * weight).alias("score"))
        return out if k is None else out.orderBy(F.desc("score"), self.key).offset(offset).limit(k)

    def any_of(self, terms: list[str]) -> DataFrame:
        return self._of(terms).select(self.key).distinct()

    def all_of(self, terms: list[str]) -> DataFrame:
        want = len(set(terms))
        return self._of(terms).groupBy(self.key).agg(F.count_distinct("token").alias("n")).filter(F.col("n") == want).select(self.key)

    def prefix(self, prefix: str) -> DataFrame:
        """Documents with a token that begins so."""
        return self.rows.filter(F.startswith("token", F.lit(prefix))).select(self.key).distinct()

    def phrase(self, terms: list[str]) -> DataFrame:
        """Documents in which the terms follow each other: all of them, less its place each, begin at one position."""
        order = self.rows.sparkSession.createDataFrame(list(enumerate(terms)), "nth int, token string")
        found = self._of(terms).select("token", self.key, F.explode("at").alias("at"))
        begins = found.join(F.broadcast(order), "token").groupBy(self.key, (F.col("at") - F.col("nth")).alias("start"))
        return begins.agg(F.count_distinct("nth").alias("n")).filter(F.col("n") == len(terms)).select(self.key).distinct()

    def boolean(self, must: list[str] = (), should: list[str] = (), must_not: list[str] = (), phrases: list[list[str]] = (), prefixes: list[str] = ()) -> DataFrame:
        """Documents with all of ``must``, every phrase and prefix, any of ``should`` (if given), and none of ``must_not``."""
        parts = ([self.all_of(list(must))] if must else []) + [self.phrase(p) for p in phrases] + [self.prefix(p) for p in prefixes] + ([self.any_of(list(should))] if should else [])
        out = parts[0]
        for p in parts[1:]:
            out = out.join(p, self.key, "left_semi")
        return out.join(self.any_of(list(must_not)), self.key, "left_anti") if must_not else out

    def stemmed(self, term: str) -> DataFrame:
        """Documents with a token of the term's stem, which such a token begins with."""
        stem = self.rows.sparkSession.range(1).select(stem_of(F.lit(term))).first()[0]
        return self.rows.filter(F.startswith("token", F.lit(stem)) & (stem_of(F.col("token")) == stem)).select(self.key).distinct()


def stem_of(token: Column) -> Column:
    """A plain English stem: plural and verb endings go from tokens that keep three letters; for matching, not for reading."""
    out = F.regexp_replace(token, r"(?<=\w{3})(sses|ies)$", "")
    out = F.regexp_replace(out, r"(?<=\w{3})(ingly|edly|ing|ed|es|s|ly)$", "")
    return F.regexp_replace(out, r"(?<=\w{2})([bdfgmnprt])\1$", "$1")


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], k: int | None = None) -> DataFrame:
    """(key, score) of documents with any term.

    Term frequencies come from array functions on the document's own row, so nothing is
    exploded or shuffled; document frequencies are one small aggregate.
    """
    listed = docs.select(key, tokens(F.col(text)).alias("ts"))
    tf = lambda t: F.size(F.filter("ts", lambda x: x == t))
    counted = listed.select(key, F.size("ts").alias("dl"), *[tf(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    scored = counted.filter(F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) > 0).join(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = scored.select(key, score.alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), key).limit(k)


def match_all(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    ts = tokens(F.col(text))
    return docs.filter(F.size(F.array_except(F.array(*[F.lit(t) for t in terms]), ts)) == 0)


def match_phrase(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    joined = F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), " "), F.lit(" "))
    return docs.filter(F.contains(joined, F.lit(" " + " ".join(terms) + " ")))


def match_prefix(docs: DataFrame, text: str, prefix: str) -> DataFrame:
    return docs.filter(F.exists(tokens(F.col(text)), lambda t: F.startswith(t, F.lit(prefix))))


def match_none(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    return docs.filter(~F.arrays_overlap(tokens(F.col(text)), F.array(*[F.lit(t) for t in terms])))


def snippet(text: Column, terms: list[str], width: int = 32) -> Column:
    """The words around the first term, terms marked."""
    ws = F.split(text, r"\s+")
    hit = lambda w: F.arrays_overlap(tokens(w), F.array(*[F.lit(t) for t in terms]))
    at = F.greatest(F.array_position(F.transform(ws, hit), True) - 8, F.lit(1))
    return F.array_join(F.transform(F.slice(ws, at.cast("int"), width), lambda w: F.when(hit(w), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)), " ")


def nearest(rows: DataFrame, key: str, distance: Column, k: int, ascending: bool = True) -> DataFrame:
    """(key, distance) of the k best: a top-k per task, then one of those; ties by key."""
    out = rows.select(key, distance.alias("distance"))
    return out.orderBy(F.col("distance").asc() if ascending else F.col("distance").desc(), key).limit(k)


def within_radius(rows: DataFrame, lat: str, lng: str, at: tuple[float, float], km: float) -> DataFrame:
    """Rows within km of a place, with ``distance``; a box is skipped by before the distance is worked out."""
    d = geo.haversine(F.col(lat), F.col(lng), F.lit(at[0]), F.lit(at[1]))
    limit = km if km > 0 else 0.001
    return rows.filter(geo.near_box(F.col(lat), F.col(lng), *at, limit)).withColumn("distance", d).filter(F.col("distance") <= limit)


def normalized(score: Column, source: str) -> Column:
    """A score from 0 to 1: of text above 0 it is s / (1 + s), of vectors it is cut, of distances it decays from 1."""
    if source == "fts":
        return F.when(score > 0, score / (1 + score)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) if source == "vector" else F.when(score > 0, F.exp(-score)).otherwise(1.0)


def fuse_rrf(sources: dict[str, DataFrame], key: str, k: int = RRF_K, limit: int = 1000) -> DataFrame:
    """Reciprocal rank fusion of the ``limit`` best of each (key, score) table, best score first in each.

    Each list is cut by a top-k, so that ranking it is bounded whatever the size of the tables.
    """
    rows = None
    for name, s in sources.items():
        s = s.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(limit).withColumn("source", F.lit(name))
        rows = s if rows is None else rows.unionByName(s)
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), key))
    return rows.withColumn("rank", rank).groupBy(key).agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def fuse_weighted(sources: dict[str, tuple[DataFrame, float]], key: str, present: bool = False) -> DataFrame:
    """Weighted mean over all weights, or over those of the sources ``present`` for a key (weight above 0; none gives 0).

    The primary source weighs most in the sum.
    """
    rows, total = None, sum(w for _, w in sources.values())
    for name, (s, w) in sources.items():
        s = s.groupBy(key).agg(F.max("score").alias("score")).select(key, (F.col("score") * w).alias("part"), F.lit(float(w)).alias("weight"), F.lit(name).alias("source"))
        rows = s if rows is None else rows.unionByName(s)
    counted = F.col("weight") > 0
    mean = F.coalesce(F.sum(F.when(counted, F.col("part"))) / F.sum(F.when(counted, F.col("weight"))), F.lit(0.0)) if present else F.sum("part") / total
    return rows.groupBy(key).agg(mean.alias("score"), F.max_by("source", F.struct("part", "source")).alias("primary_source"))


def contains_name(rows: DataFrame, columns: list[str], text: str, key: str, limit: int = 50) -> DataFrame:
    """Rows one of whose names holds a text, whatever its case; the first ``limit`` by key."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
    return rows.filter(hit).orderBy(key).limit(limit)
