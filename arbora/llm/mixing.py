"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order, null last, weigh 5, 2, 1, repeating, and share the words
of the whole table; a target stops at three times its source's words and the excess is
shared again by weight.  A document's expected copies are target / source words.  The
fractional parts are rounded in pairs: one of two documents gives its mass to the
other until one is 0 or 1.  Blocks of one source's documents, largest first, each leave
at most one fractional document; these meet in blocks of the next level, a reduction
tree of ``FAN_IN`` that ends with one document per source, rounded at random.

Randomness comes from hashes of a block's key, so reruns agree.  Defined cases: a null
text has no words and is taken with 0 words; a null source is a source; identical rows
are interchangeable; an empty table gives an empty result; extra columns pass through
``apply`` and never clash with the operator's own, which start with ``mx_``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.scratch import materialize
from arbora.llm.text import word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
BLOCK = 512
FAN_IN = 64


def weighted(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` with ``mx_weight`` by rank; ranks come from sorted partitions and their counts."""
    spark = sources.sparkSession
    parted = materialize(sources.sort(F.col("mx_source").asc_nulls_last()).withColumn("mx_pos", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("mx_pos", 33)
    counts = {r["part"]: r["n"] for r in parted.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = [], 0
    for k in sorted(counts):
        before.append((k, at))
        at += counts[k]
    offsets = spark.createDataFrame(before or [(0, 0)], "mx_part long, mx_before long")
    rank = F.col("mx_pos") - F.shiftleft(F.col("mx_part"), 33) + F.col("mx_before")
    chosen = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int") + 1)
    return parted.join(F.broadcast(offsets), part == F.col("mx_part")).withColumn("mx_weight", chosen).drop("mx_pos", "mx_part", "mx_before")


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` with ``mx_target``: a level per unit of weight, raised until no share is above its limit."""
    limit = F.col("mx_source_size") * float(MAX_REPEAT)
    level, capped = 0.0, -1
    while True:
        full = limit <= F.col("mx_weight") * level
        row = sources.agg(
            F.coalesce(F.sum("mx_source_size"), F.lit(0)).alias("all"),
            F.sum(full.cast("int")).alias("n"),
            F.sum(F.when(full, limit).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("mx_weight"))).alias("weight"),
        ).first()
        if not row["weight"] or row["n"] == capped and level > 0:
            break
        capped, level = row["n"], (row["all"] - row["held"]) / row["weight"]
    return sources.withColumn("mx_target", F.least(limit, F.col("mx_weight") * level))


def _round(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    """One block: pairs of fractional documents until one at most is left; ``last`` rounds that one too."""
    pdf = pdf.sort_values(["mx_size", "mx_key"], ascending=[False, True], kind="stable").reset_index(drop=True)
    frac, copies = pdf["mx_frac"].to_numpy(float).copy(), pdf["mx_copies"].to_numpy(int).copy()
    first = pdf.iloc[0]
    seed = zlib.crc32(f"{first['mx_source']}/{first['mx_block']}/{len(pdf)}/{last}".encode())
    draws = np.random.Generator(np.random.PCG64(seed)).random(len(pdf) + 1)
    open_at, tiny = -1, 1e-9
    for i in range(len(pdf)):
        if frac[i] <= tiny or frac[i] >= 1 - tiny:
            copies[i] += round(frac[i])
            frac[i] = 0.0
            continue
        if open_at < 0:
            open_at = i
            continue
        j, a, b = open_at, frac[open_at], frac[i]
        total = a + b
        if total < 1:
            giver, taker = (j, i) if draws[i] < b / total else (i, j)
            frac[giver], frac[taker] = 0.0, total
        else:
            full, taker = (j, i) if draws[i] < (1 - b) / (2 - total) else (i, j)
            copies[full] += 1
            frac[full], frac[taker] = 0.0, total - 1
        open_at = taker
        if frac[taker] <= tiny or frac[taker] >= 1 - tiny:
            copies[taker] += round(frac[taker])
            frac[taker] = 0.0
            open_at = -1
    if last and open_at >= 0:
        copies[open_at] += int(draws[-1] < frac[open_at])
        frac[open_at] = 0.0
    return pdf.assign(mx_frac=frac, mx_copies=copies)


def _round_open(pdf: pd.DataFrame) -> pd.DataFrame:
    return _round(pdf, False)


def _round_last(pdf: pd.DataFrame) -> pd.DataFrame:
    return _round(pdf, True)


def copies(rows: DataFrame) -> DataFrame:
    """Copies of each row of (mx_key, mx_source, mx_size): mx_copies, mx_target, mx_source_size."""
    rows = materialize(rows, "sizes")
    sources = rows.groupBy("mx_source").agg(F.sum("mx_size").alias("mx_source_size"), F.count(F.lit(1)).alias("mx_n"))
    sources = targets(materialize(weighted(sources), "weights"))
    rate = F.when(F.col("mx_source_size") > 0, F.col("mx_target") / F.col("mx_source_size")).otherwise(0.0)
    sources = sources.select(
        F.col("mx_source").alias("mx_s"), "mx_source_size", "mx_target", "mx_n",
        F.floor(rate).cast("int").alias("mx_copies"), (rate - F.floor(rate)).alias("mx_frac"),
    )
    sources = materialize(sources, "targets")
    blocks = F.ceil(F.col("mx_n") / BLOCK)
    cur = rows.join(sources, F.col("mx_source").eqNullSafe(F.col("mx_s"))).drop("mx_s")
    cur = cur.withColumn("mx_block", F.pmod(F.xxhash64("mx_key", "mx_size"), blocks).cast("long")).drop("mx_n")
    most = sources.agg(F.max(blocks)).first()[0] or 0
    done = []
    while True:
        last = most <= 1
        block = _round_last if last else _round_open
        out = materialize(cur.groupBy("mx_source", "mx_block").applyInPandas(block, cur.schema), "level")
        done.append(out.filter("mx_frac = 0"))
        if last:
            break
        cur = out.filter("mx_frac > 0").withColumn("mx_block", F.floor(F.col("mx_block") / FAN_IN))
        most = -(-most // FAN_IN)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.drop("mx_frac", "mx_block")


def _keyed(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("mx_key"), F.col(source).alias("mx_source"), word_count(F.col(text)).alias("mx_size"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """A row per document: key, size, source_size, target, copies, taken."""
    return copies(_keyed(docs, key, source, text)).select(
        F.col("mx_key").alias(key), F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"),
        F.col("mx_target").alias("target"), F.col("mx_copies").alias("copies"), (F.col("mx_copies") * F.col("mx_size")).alias("taken"),
    )


def apply(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed table: each document as often as the mix takes it, with its columns."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit("\x00"))
    taken = copies(_keyed(docs, key, source, text)).groupBy(name(F.col("mx_key")).alias("mx_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("mx_size", "mx_source", "mx_copies"))), lambda x: x["mx_copies"]).alias("mx_copies")
    )
    nth = F.row_number().over(Window.partitionBy("mx_name").orderBy(word_count(F.col(text)), F.col(source)))
    numbered = docs.withColumn("mx_name", name(F.col(key))).withColumn("mx_nth", nth)
    joined = numbered.join(taken, F.col("mx_name") == F.col("mx_id"))
    times = F.array_repeat(F.lit(1), F.get("mx_copies", F.col("mx_nth") - 1))
    return joined.withColumn("mx_each", F.explode(times)).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
