"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

Tokens are lower-case (A-Z) words and one end mark per text.  The commonest tokens of
the training texts are classes of their own; all others fall into ``BUCKETS`` classes by
their last two bytes, inside which a smoothed unigram tells them apart.  A class is predicted from the two before it:
score = (R[w1] C1 + R[w2] C2) . Q[w] + b[w].  Training starts on a bounded sample and goes
on in every task over all training texts; the tasks' parameters are averaged, weighted
by tokens.  Because the score is linear in each context word, batched matrix products
give two score tables and the normaliser of every context, and scoring is exact lookup.

Counts: every training token is counted.  The commonest ``HEAD`` counts go to each task;
the rest meet their counts in a join on the word, where no word is common enough to skew.

Defined cases: a null text is empty and has the end mark only; a null id is trained on;
repeated rows are scored alike and counted as often; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.scratch import materialize
from arbora.llm.text import slices

HEAD = 131_072
CLASSES, BUCKETS = 510, 128
DIM = 16
NOISE, BATCH = 32, 4096
RATE, REFINE_RATE = 0.1, 0.05
#: Texts, and tokens, that the sample that training starts on has on average at most; it is drawn as whole texts.
SAMPLE_TEXTS, SAMPLE_TOKENS = 2000, 1_000_000
#: Entries of a task's counter before it is emptied; bounds memory, not results.
HELD = 300_000
#: Bytes of text that a task turns into tokens at once.
CHUNK = 1_000_000
END = b""


def is_trained_on(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 1, F.lit(True))


def tokens(text: bytes | None) -> list[bytes]:
    """Words and the end mark; bytes.lower and bytes.split know ASCII letters and white space only."""
    return [*(text or b"").lower().split(), END]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            held.update(tokens(text.as_py()))
            if len(held) > HELD:
                yield rows()
    yield rows()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("blob"))


class Net:
    """Parameters of ``k`` classes, the last of which stands before a text."""

    def __init__(self, k: int, unigram: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.k, self.unigram = k, unigram
        drawn = {
            "r": rng.normal(0, 0.3, (k, DIM)), "q": rng.normal(0, 0.3, (k, DIM)),
            "c1": np.eye(DIM) * 0.5, "c2": np.eye(DIM) * 0.3, "b": np.log(unigram),
        }
        self.p = {name: x.astype(np.float32) for name, x in drawn.items()}
        self.g = {name: np.full(x.shape, 1e-2, np.float32) for name, x in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name, x in self.p.items():
            self.p[name] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def train(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, rate: float, rng: np.random.Generator) -> None:
        """Adagrad steps; each batch is told from ``NOISE`` words drawn from the unigram."""
        p, k = self.p, self.k
        log_noise = np.log(NOISE * self.unigram).astype(np.float32)
        for at in range(0, len(w), BATCH):
            a, b, t = w1[at : at + BATCH], w2[at : at + BATCH], w[at : at + BATCH]
            noise = rng.choice(k, NOISE, p=self.unigram)
            ra, rb, qt, qn = p["r"].take(a, 0), p["r"].take(b, 0), p["q"].take(t, 0), p["q"][noise]
            bias = p["b"] - log_noise
            h = ra @ p["c1"] + rb @ p["c2"]
            gt = _sigmoid(-np.einsum("ij,ij->i", h, qt) - bias.take(t))
            gn = -_sigmoid(h @ qn.T + bias[noise])
            dh = gt[:, None] * qt + gn @ qn
            d = {
                "r": _scatter(a, dh @ p["c1"].T, k) + _scatter(b, dh @ p["c2"].T, k),
                "q": _scatter(t, gt[:, None] * h, k) + _scatter(noise, gn.T @ h, k),
                "c1": ra.T @ dh, "c2": rb.T @ dh,
                "b": np.bincount(t, gt, k) + np.bincount(noise, gn.sum(0), k),
            }
            for name, x in d.items():
                x = x.astype(np.float32) / np.float32(np.sqrt(len(t)))
                self.g[name] += x * x
                p[name] += np.float32(rate) * x / np.sqrt(self.g[name])

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by (w1, w) and (w2, w), and the log normaliser by (w1, w2); the mark before a text is never predicted."""
        p = {name: x.astype(float) for name, x in self.p.items()}
        t1 = (p["r"] @ p["c1"] @ p["q"].T + p["b"])[:, :-1]
        t2 = (p["r"] @ p["c2"] @ p["q"].T)[:, :-1]
        top1, top2 = t1.max(1, keepdims=True), t2.max(1, keepdims=True)
        z = np.log(np.exp(t1 - top1) @ np.exp(t2 - top2).T) + top1 + top2.T
        return t1, t2, z


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scatter(at: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Sums of rows by ``at``."""
    return np.array([np.bincount(at, column, k) for column in np.ascontiguousarray(rows.T)]).T


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def bucket_column(word: Column) -> Column:
    return (F.crc32(F.substring(word, F.greatest(F.length(word) - 1, F.lit(1)), F.lit(2))) % BUCKETS).cast("int")


class Vocabulary:
    """The commonest words with their counts; the first ``classes`` are classes of their own.

    buckets: tokens and distinct words by bucket, over all words.
    """

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, buckets: dict[int, tuple[int, int]]):
        self.id = {w: k for k, w in enumerate(words)}
        self.classes = min(CLASSES, len(words))
        self.total, self.distinct = total, distinct
        self.log_count = np.log10(np.array(counts, float) + 0.5)
        self.of_head = np.array([k if k < self.classes else self.classes + bucket(w) for k, w in enumerate(words)], np.int32)
        tokens_in, words_in = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for b, (n, v) in buckets.items():
            tokens_in[b], words_in[b] = n, v
        for w, n in zip(words[: self.classes], counts, strict=False):
            tokens_in[bucket(w)] -= n
            words_in[bucket(w)] -= 1
        self.log_bucket = np.log10(tokens_in + 0.5 * (words_in + 1))
        mass = np.array([*counts[: self.classes], *tokens_in, 0], float) + 0.5
        self.unigram = mass / mass.sum()

    def ids(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.id.get, found, repeat(-1)), np.int32, len(found))

    def classed(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
        """Of several texts: ids (-1: not in the head), classes, where each text begins, and the words that are not in the head."""
        found = [tokens(b) for b in blobs]
        ids = [self.ids(f) for f in found]
        tails = [[f[i] for i in np.flatnonzero(x < 0)] for f, x in zip(found, ids, strict=True)]
        starts = np.concatenate(([0], np.cumsum([len(f) for f in found])[:-1]))
        flat = np.concatenate(ids)
        w = self.of_head[flat] if len(self.of_head) else np.zeros(len(flat), np.int32)
        w[flat < 0] = [self.classes + bucket(t) for tail in tails for t in tail]
        return flat, w, starts, tails

    def contexts(self, w: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes one and two tokens before."""
        first = self.classes + BUCKETS
        w1, w2 = np.roll(w, 1), np.roll(w, 2)
        w1[starts] = w2[starts] = first
        second = starts + 1
        w2[second[second < len(w)]] = first
        return w1, w2


def count(docs: DataFrame) -> DataFrame:
    """(word, n) over all training texts."""
    rows = _rows(docs.filter(is_trained_on(F.col("doc_id")))).select("blob")
    return rows.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def start_texts(rows: DataFrame, n_docs: int, n_tokens: int) -> list[bytes]:
    """Whole texts drawn by a hash, each with the same chance, whatever its length and place."""
    share = min(1.0, SAMPLE_TEXTS / max(1, n_docs), SAMPLE_TOKENS / max(1, n_tokens))
    drawn = F.pmod(F.xxhash64("doc_id", "blob", F.lit(3)), F.lit(1 << 40)) < int(share * (1 << 40))
    return [r["blob"] for r in rows.filter(drawn).select("blob").collect()]


def fit(docs: DataFrame, vocabulary: Vocabulary, n_docs: int) -> Net:
    """One pass over all training texts, from a start on a bounded sample."""
    k = vocabulary.classes + BUCKETS + 1
    net = Net(k, vocabulary.unigram)
    rows = _rows(docs.filter(is_trained_on(F.col("doc_id"))))
    sample = start_texts(rows, n_docs, vocabulary.total)
    if sample:
        _, w, starts, _ = vocabulary.classed(sample)
        w1, w2 = vocabulary.contexts(w, starts)
        rng = np.random.default_rng(1)
        for _ in range(3):
            net.train(w1, w2, w, RATE, rng)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        own, rng, seen = Net(k, vocabulary.unigram), np.random.default_rng(2), 0
        own.load(start)
        own.g = {name: g.copy() for name, g in slopes.items()}
        for batch in batches:
            for piece in slices(batch, "blob", CHUNK):
                _, w, starts, _ = vocabulary.classed(piece.column("blob").to_pylist())
                own.train(*vocabulary.contexts(w, starts), w, REFINE_RATE, rng)
                seen += len(w)
        if seen:
            flat = own.flat()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat.astype(float) * seen), pa.array(np.full(len(flat), float(seen)))], names=["i", "x", "n"])

    start, slopes = net.flat(), net.g
    parts = rows.select("blob").mapInArrow(refine, "i int, x double, n double").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x"))
    averaged = parts.collect()  # as many rows as the model has parameters
    if averaged:
        flat = net.flat()
        flat[[r["i"] for r in averaged]] = [r["x"] for r in averaged]
        net.load(flat)
    return net


def head_level(levels: list) -> int:
    """The lowest level of counts, sixteen to a doubling, above which ``HEAD`` words lie at most.

    With it a filter picks the head; a top-k would send ``HEAD`` rows of every task to the driver.
    """
    least, held = 1 << 30, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        held += r["words"]
        if held > HEAD:
            break
        least = r["level"]
    return least


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per row of ``docs``."""
    counts = materialize(count(docs), "counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.length("word") == 0, F.col("n"))).alias("docs")).first()
    level = F.floor(F.log2("n") * 16)
    least = head_level(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect())
    head = sorted(counts.filter(level >= least).collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    by_bucket = counts.groupBy(bucket_column(F.col("word")).alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    vocabulary = Vocabulary([bytes(r["word"]) for r in head], [r["n"] for r in head], totals["n"], totals["v"], {r["b"]: (r["n"], r["v"]) for r in by_bucket})
    t1, t2, z = (x / np.log(10) for x in fit(docs, vocabulary, totals["docs"] or 0).tables())
    t1, t2, z = (x.astype(np.float32) for x in (t1, t2, z))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole, "blob", CHUNK)):
            ids, w, starts, tails = vocabulary.classed(batch.column("blob").to_pylist())
            w1, w2 = vocabulary.contexts(w, starts)
            known = ids >= 0
            logs = np.where(known, vocabulary.log_count[np.maximum(ids, 0)] if len(head) else 0.0, 0.0)
            other = w >= vocabulary.classes
            inside = np.where(other, logs - vocabulary.log_bucket[np.maximum(w - vocabulary.classes, 0)], 0.0)
            sums = lambda x: np.add.reduceat(x.astype(float), starts)
            model = t1[w1, w].astype(float) + t2[w2, w] - z[w1, w2]
            lengths = np.diff([*starts, len(w)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(sums(known).astype(np.int64)), pa.array(sums(logs)), pa.array(sums(model + inside)), pa.array(tails, pa.list_(pa.binary()))],
                names=["row", "doc_id", "n_tokens", "n_head", "logs", "model", "tail"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"row long, doc_id {kind}, n_tokens long, n_head long, logs double, model double, tail array<binary>"
    parts = materialize(_rows(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, shape), "scored")
    rare = counts.filter(level < least)
    tail = parts.select("row", F.explode("tail").alias("word")).join(rare, "word", "left")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail_logs"), F.count("n").alias("n_tail"))
    both = parts.drop("tail").join(tail, "row", "left").na.fill(0, ["tail_logs", "n_tail"])
    all_mass = float(np.log10(totals["n"] + 0.5 * (totals["v"] + 1)))
    return both.select(
        "doc_id",
        (~is_trained_on(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("n_head") + F.col("n_tail")).alias("n_known"),
        F.lit(totals["n"]).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("tail_logs") - F.col("n_tokens") * all_mass).alias("base_score"),
        (F.col("model") + F.col("tail_logs")).alias("score"),
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
