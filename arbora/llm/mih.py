"""Nearest neighbours by multi-index hashing.

Vectors get binary codes from learned rotations (iterative quantisation of a bounded
sample).  A code is cut into substrings; each substring is indexed by its value.  If two
codes differ in at most ``radius`` bits, some substring differs in at most
``radius // substrings`` bits, so probing the values that near to the query's substrings
finds every code within the radius; those are reranked by inner product in doubles.

The index is cut into blocks of rows by a hash of the id and the queries into blocks
likewise; a task probes one block of the index with one block of queries and sends the
best k of each query on.  The radius is chosen so that a sample of queries reaches
``TARGET`` recall.  A limit on the norm turns inner products into angles: each row gets
one more component that lifts it to the largest norm.

Defined cases: vectors that are null, empty, zero, of another than the commonest length
or that hold null or non-finite components take no part; a query meets no row that has
its own id, so repeated ids don't find each other; rows that repeat an id count once, with
the least vector; ties go to the smaller id; with too few codes inside the radius a
query's block is scanned, so that k are found if there are k.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.scratch import materialize

BITS = 128
SUBSTRING = 8
#: Rows that the rotations and the radius are fitted on, at most.
SAMPLE = 8192
SAMPLE_QUERIES = 256
TARGET = 0.97
#: Rows of the index, and queries, in a block.
BLOCK, QUERY_BLOCK = 65_536, 4_096
#: Smaller tables are cut into so many blocks, of ``LEAST`` rows or more, to use more tasks.
PARALLEL, LEAST = 16, 1024

_POP = np.array([bin(x).count("1") for x in range(256)], np.uint8)
_NEAR = _POP[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


@dataclass
class Coder:
    """Centre and rotations; codes are the signs of the rotated vectors."""

    centre: np.ndarray
    turn: np.ndarray
    norm: float
    radius: int = 0

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(1)))
        unit = self.norm / np.maximum(1e-300, np.sqrt((x * x).sum(1))) if query else np.ones(len(x))
        return np.column_stack([x * unit[:, None], rest])

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """A byte per substring."""
        return np.packbits((self.lifted(x, query) - self.centre) @ self.turn > 0, axis=1)


def fit(sample: np.ndarray, norm: float, bits: int = BITS, seed: int = 7) -> Coder:
    """Rotations by alternating between the signs and the rotation that fits them best."""
    rng = np.random.default_rng(seed)
    coder = Coder(np.zeros(sample.shape[1] + 1), np.zeros((0, 0)), norm)
    lifted = coder.lifted(sample)
    coder.centre = lifted.mean(0)
    centred = lifted - coder.centre
    turns = []
    while sum(t.shape[1] for t in turns) < bits:
        turn = np.linalg.qr(rng.standard_normal((centred.shape[1],) * 2))[0]
        for _ in range(20):
            signs = np.where(centred @ turn > 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(centred.T @ signs)
            turn = u @ v
        turns.append(turn)
    coder.turn = np.hstack(turns)[:, :bits]
    return coder


def choose_radius(coder: Coder, sample: np.ndarray, asked: np.ndarray, k: int, target: float = TARGET) -> int:
    """The least radius that holds ``target`` of the true neighbours in the sample of its rows ``asked``.

    A sample's neighbours lie farther off than those in the whole table: the radius errs to the safe side.
    """
    queries = sample[asked]
    score = queries @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf  # the query itself
    best = np.argsort(-score, axis=1)[:, : min(k, len(sample))]
    far = _POP[coder.codes(queries, True)[:, None, :] ^ coder.codes(sample)[best]].sum(2)
    return int(np.quantile(far, target))


class Index:
    """Rows of a block by the value of each substring, and lists of the rows near to a value, kept as bit sets."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.wide = _wide(codes)
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]
        self.probed: dict[tuple[int, int, int], np.ndarray] = {}

    def probe(self, j: int, value: int, reach: int) -> np.ndarray:
        """Bit set of the rows whose substring ``j`` differs from ``value`` in at most ``reach`` bits."""
        found = self.probed.get((j, value, reach))
        if found is None:
            met = np.zeros(len(self.codes), bool)
            for near in np.flatnonzero(_NEAR[value] <= reach):
                met[self.order[j][self.starts[j][near] : self.starts[j][near + 1]]] = True
            found = self.probed[j, value, reach] = np.packbits(met)
        return found

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs from ``code`` in at most ``radius`` bits.

        Pigeonhole with a remainder: the first radius % m + 1 substrings are probed to
        radius // m bits, the others to one bit less.
        """
        m = self.codes.shape[1]
        met = np.zeros(-(-len(self.codes) // 8), np.uint8)
        for j, value in enumerate(code.tolist()):
            reach = radius // m - (j > radius % m)
            if reach >= 0:
                met |= self.probe(j, value, reach)
        rows = np.flatnonzero(np.unpackbits(met, count=len(self.codes)))
        differ = np.bitwise_count(self.wide[rows] ^ _wide(code[None])).sum(1, dtype=np.int32)
        return rows[differ <= radius]


def _wide(codes: np.ndarray) -> np.ndarray:
    """Codes as 64-bit words, padded with zero bits."""
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)


def _best(ids: np.ndarray, vectors: np.ndarray, own: int, query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of ``rows``: (score descending, id ascending), the query's own id left out."""
    rows = rows[ids[rows] != own]
    score = vectors[rows] @ query
    if len(rows) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        rows = rows[score >= least - 1e-9 * (1 + abs(least))]
    score = (vectors[rows] * query).sum(1)  # summed alike for each row, so equal vectors tie
    first = np.lexsort((ids[rows], -score))[:k]
    return ids[rows][first], score[first]


def _searcher(coder: Coder, k: int):
    def run(base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(base) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids, vectors = base["vec_id"].to_numpy(np.int64), np.stack(base["v"].to_numpy())
        index = Index(coder.codes(vectors))
        queries = np.stack(asked["v"].to_numpy())
        codes = coder.codes(queries, True)
        out: list[tuple[np.ndarray, ...]] = []
        for own, query, code in zip(asked["vec_id"].to_numpy(np.int64), queries, codes, strict=True):
            rows = index.within(code, coder.radius)
            if len(rows) < k + 1:
                rows = np.arange(len(ids))
            found, score = _best(ids, vectors, own, query, rows, k)
            out.append((np.full(len(found), own), found, score))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def valid(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): doubles of the vectors that take part, one row per id."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.filter(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.coalesce(sound, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def search(base: DataFrame, queries: DataFrame, k: int = 20, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query.

    base, queries: (vec_id, v) as from ``valid``.  The driver gets ``SAMPLE`` vectors at most.
    """
    spark = base.sparkSession
    row = base.select(F.size("v").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if row is None:
        return empty
    base, queries = base.filter(F.size("v") == row["d"]), queries.filter(F.size("v") == row["d"])
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    asked = queries.count()
    if not asked:
        return empty
    mixed = F.xxhash64("vec_id", F.lit(11))
    share = min(1.0, 1.2 * SAMPLE / stats["n"])
    drawn = base.filter(F.pmod(mixed, F.lit(1_000_000)) < share * 1_000_000).limit(SAMPLE).collect()
    sample = np.array([r["v"] for r in drawn], float).reshape(-1, row["d"])
    unique = np.unique(sample, axis=0)
    coder = fit(unique if len(unique) > 1 else np.vstack([sample, np.eye(row["d"])]), float(np.sqrt(stats["m"])), bits)
    tried = np.arange(0, len(unique), max(1, len(unique) // SAMPLE_QUERIES))
    coder.radius = choose_radius(coder, unique, tried, k) if len(unique) > k else bits
    blocks = max(-(-stats["n"] // BLOCK), min(PARALLEL, -(-stats["n"] // LEAST)))
    asks = -(-asked // QUERY_BLOCK)
    left = base.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("q", F.explode(_upto(asks)))
    right = queries.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(asks))).withColumn("b", F.explode(_upto(blocks)))
    met = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(_searcher(coder, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = materialize(valid(table), "vectors")
    return search(rows, rows.filter(F.col("vec_id") % 20 == 0))
