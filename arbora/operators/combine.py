"""Merges of result sets, aggregates with zero on empty input, pages and cursors."""

from __future__ import annotations

import base64
import hashlib
import json
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_union(sets: list[DataFrame], key: str) -> DataFrame:
    """Every key once; of several rows the one of the first set that has it."""
    rows = None
    for k, s in enumerate(sets):
        s = s.withColumn("_set", F.lit(k))
        rows = s if rows is None else rows.unionByName(s)
    order = Window.partitionBy(key).orderBy("_set", *[c for c in sets[0].columns if c != key])
    return rows.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_set", "_nth")


def union_all(sets: list[DataFrame]) -> DataFrame:
    """Every row of every set, with the ordinal of its set."""
    rows = None
    for k, s in enumerate(sets):
        s = s.withColumn("set_no", F.lit(k))
        rows = s if rows is None else rows.unionByName(s)
    return rows


def aggregate_sets(sets: list[DataFrame], key: str, field: str, function: str, pre_merge: bool = False) -> DataFrame:
    """An aggregate over several result sets: of their merge, or of all their rows if ``pre_merge``."""
    return aggregate(union_all(sets) if pre_merge else merge_union(sets, key), field, function)


def merge_intersection(sets: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first set whose key every set has."""
    out = sets[0]
    for s in sets[1:]:
        out = out.join(s.select(key), key, "left_semi")
    return out


def merge_ordered(sets: list[DataFrame], key: str, by: str, descending: bool = False) -> DataFrame:
    c = F.col(by)
    return merge_union(sets, key).orderBy(c.desc() if descending else c, key)


def dedupe(rows: DataFrame, key: str, field: str, newest: bool = True) -> DataFrame:
    """The row of each key with the greatest, or least, field."""
    pick = F.max_by if newest else F.min_by
    return rows.groupBy(key).agg(pick(F.struct(*[c for c in rows.columns if c != key]), F.col(field)).alias("r")).select(key, "r.*")


def quorum(rows: DataFrame, key: str, least: int, strict: bool = False) -> DataFrame:
    """Variants of a key that at least ``least`` replicas agree on; strict raises if a key has none."""
    fields = [c for c in rows.columns if c != key]
    votes = rows.groupBy(key, *fields).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(key).agg(F.max_by(F.struct("votes", *fields), F.struct("votes", *fields)).alias("r")).select(key, "r.*")
    if strict:
        return best.withColumn("votes", F.when(F.col("votes") >= least, F.col("votes")).otherwise(F.raise_error(F.lit("no quorum")).cast("long")))
    return best.filter(F.col("votes") >= least)


def aggregate(rows: DataFrame, field: str, function: str, group: list[str] | None = None) -> DataFrame:
    """sum, avg, min, max or count of the values of a field that are numbers; others are skipped, nothing gives 0."""
    c = F.col(field).try_cast("double")
    agg = {"sum": F.sum(c), "avg": F.avg(c), "min": F.min(c), "max": F.max(c), "count": F.count(c)}[function]
    return rows.groupBy(*(group or [])).agg(F.coalesce(agg, F.lit(0)).alias("value"))


def top_groups(rows: DataFrame, by: Column, n: int = 20) -> DataFrame:
    """The commonest values and their counts; ties by value."""
    return rows.groupBy(by.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def latency_stats(rows: DataFrame, c: str) -> DataFrame:
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")
    return rows.agg(F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("deviation"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"))


def offset_page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def keyset_page(rows: DataFrame, key: str, after: object, limit: int) -> DataFrame:
    """The page after a key: a pushed filter and a top-k, whatever the page number."""
    return (rows if after is None else rows.filter(F.col(key) > F.lit(after))).orderBy(key).limit(limit)


MAX_AGE = 3600


def cursor(query: str, last: object, offset: int, now: float | None = None) -> str:
    """A token bound to its query."""
    body = {"last": last, "query": hashlib.sha256(query.encode()).hexdigest(), "at": time.time() if now is None else now, "offset": offset}
    return base64.urlsafe_b64encode(json.dumps(body).encode()).decode()


def read_cursor(token: str, query: str, now: float | None = None) -> tuple[object, int]:
    """(last key, offset); a token of another query, too old or malformed is refused."""
    try:
        body = json.loads(base64.urlsafe_b64decode(token.encode()))
        last, of, at, offset = body["last"], body["query"], body["at"], body["offset"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("malformed cursor") from e
    if of != hashlib.sha256(query.encode()).hexdigest():
        raise ValueError("cursor of another query")
    if offset < 0 or (time.time() if now is None else now) - at > MAX_AGE:
        raise ValueError("cursor expired or out of range")
    return last, offset


def read_offset(token: str | None) -> int:
    """The offset of a plain cursor; 0 for what is no cursor."""
    try:
        return max(0, int(json.loads(base64.b64decode((token or "").encode()))["offset"]))
    except (ValueError, KeyError, TypeError):
        return 0


def offset_cursor(offset: int) -> str:
    return base64.b64encode(json.dumps({"offset": offset}).encode()).decode()


def level_stats(chunks: DataFrame, level: str = "level") -> DataFrame:
    """Chunks, rows and bytes by level."""
    return chunks.groupBy(level).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_rows").alias("n_rows"), F.sum("size").alias("size"))


def without_metadata(rows: DataFrame, names: tuple[str, ...] = ("_namespace", "_local_id")) -> DataFrame:
    return rows.drop(*names)


def expand_refs(rows: DataFrame, ref: str, entities: DataFrame, key: str) -> DataFrame:
    """``rows`` with the entity that ``ref`` names as a struct, null where there is none."""
    packed = entities.select(F.col(key).alias("_k"), F.struct(*entities.columns).alias(f"{ref}_entity"))
    return rows.join(packed, F.col(ref) == F.col("_k"), "left").drop("_k")
