"""Scans, versions and materialisation over the triples table.

Triples: subject, predicate, obj_type, one typed value column per family, timestamp, seq.
``obj_type`` 0 is a tombstone.  The latest version of (subject, predicate) is every
row with the greatest timestamp; tombstones are dropped after that choice, not before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Codes of the object types.
NULL, BOOL, INT32, INT64, FLOAT64, STRING, BINARY, TIMESTAMP, DATE, DURATION, REF, REF_ARRAY, JSON, GEO_POINT, GEO_POLYGON, GEO_LINESTRING, URL, VECTOR = range(18)
TYPE_NAMES = ("NULL", "BOOL", "INT32", "INT64", "FLOAT64", "STRING", "BINARY", "TIMESTAMP", "DATE", "DURATION", "REF", "REF_ARRAY", "JSON", "GEO_POINT", "GEO_POLYGON", "GEO_LINESTRING", "URL", "VECTOR")

_VALUES = {"obj_ref": "string", "obj_string": "string", "obj_int64": "long", "obj_float64": "double", "obj_bool": "boolean", "obj_timestamp": "long"}


def type_name(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in TYPE_NAMES]), code), F.lit("UNKNOWN"))


def infer_type(dtype: T.DataType) -> tuple[int, str]:
    """Object type and value column of a Spark type."""
    if isinstance(dtype, T.BooleanType):
        return BOOL, "obj_bool"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT64, "obj_float64"
    if isinstance(dtype, T.IntegralType):
        return INT64, "obj_int64"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return TIMESTAMP, "obj_timestamp"
    return STRING, "obj_string"


def _object(kind: int, value: Column | None, column: str) -> list[Column]:
    cells = [F.lit(kind).alias("obj_type")]
    for name, sql in _VALUES.items():
        cells.append((value if name == column and value is not None else F.lit(None)).cast(sql).alias(name))
    return cells


def melt(table: DataFrame, subject: Column, fields: dict[str, str], refs: dict[str, Column] | None = None, timestamp: Column | None = None) -> DataFrame:
    """Triples of a wide table in one pass: an array of structs per row, exploded; null cells are skipped.

    fields: column to predicate; refs: predicate to the IRI that it points to.
    """
    cells = []
    for column, predicate in fields.items():
        kind, home = infer_type(table.schema[column].dataType)
        value = F.unix_millis(F.col(column).cast("timestamp")) if kind == TIMESTAMP else F.col(column)
        cells.append(F.struct(F.lit(predicate).alias("predicate"), *_object(kind, value, home)))
    for predicate, target in (refs or {}).items():
        cells.append(F.struct(F.lit(predicate).alias("predicate"), *_object(REF, target, "obj_ref")))
    stamp = F.lit(0).cast("long") if timestamp is None else timestamp
    rows = table.select(subject.alias("subject"), stamp.alias("timestamp"), F.explode(F.array(*cells)).alias("t"))
    return rows.select("subject", "t.*", "timestamp").filter(F.coalesce(*[F.col(c).cast("string") for c in _VALUES]).isNotNull())


def latest(triples: DataFrame) -> DataFrame:
    """All rows of the greatest timestamp of each (subject, predicate), tombstones among them."""
    order = Window.partitionBy("subject", "predicate").orderBy(F.desc("timestamp"))
    return triples.withColumn("_age", F.rank().over(order)).filter("_age = 1").drop("_age")


def alive(triples: DataFrame) -> DataFrame:
    return latest(triples).filter(F.col("obj_type") != NULL)


def tombstones(triples: DataFrame, subjects: DataFrame, timestamp: Column) -> DataFrame:
    """Rows that delete every predicate of the given subjects."""
    gone = triples.join(subjects, "subject", "left_semi").select("subject", "predicate").distinct()
    return gone.select("subject", "predicate", *_object(NULL, None, ""), timestamp.alias("timestamp"))


def spo(triples: DataFrame, subject: str, predicate: str | None = None, versions: str = "all") -> DataFrame:
    rows = triples.filter(F.col("subject") == subject)
    rows = rows if predicate is None else rows.filter(F.col("predicate") == predicate)
    return alive(rows) if versions == "latest" else rows


def current(triples: DataFrame, subject: str, predicate: str) -> DataFrame:
    """The newest version of one (subject, predicate); a tombstone if that is the newest."""
    return latest(triples.filter((F.col("subject") == subject) & (F.col("predicate") == predicate)))


def page(rows: DataFrame, order: str = "seq", limit: int = 1000, after: int | None = None) -> tuple[DataFrame, Column]:
    """The first ``limit`` rows after a cursor, by ``order``, and the expression of the next cursor.

    The cursor is a pushed filter, so that a page costs one top-k whatever its number.
    """
    left = rows if after is None else rows.filter(F.col(order) > after)
    return left.orderBy(order).limit(limit), F.max(order)


def spo_page(triples: DataFrame, subject: str, predicate: str | None = None, limit: int = 1000, after: int | None = None) -> DataFrame:
    """All versions of a subject in the order they were written, a page at a time."""
    return page(spo(triples, subject, predicate), limit=limit, after=after)[0]


def pos_page(triples: DataFrame, predicate: str, op: str | None = None, value: object = None, limit: int = 1000, after: int | None = None) -> DataFrame:
    return page(pos(triples, predicate, op, value), limit=limit, after=after)[0]


def osp_page(triples: DataFrame, target: str, limit: int = 1000, after: int | None = None) -> DataFrame:
    return page(osp(triples, target), limit=limit, after=after)[0]


def _batch(keys: DataFrame, key: str, rows: DataFrame, fields: list[str], out: str) -> DataFrame:
    """A row per key with an array of its rows, empty where it has none."""
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(out))
    empty = F.array().cast(listed.schema[out].dataType)
    return keys.select(key).distinct().join(listed, key, "left").withColumn(out, F.coalesce(out, empty))


def spo_by_subject(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """(subject, triples) for each subject asked for; all versions."""
    found = value_text(triples.join(ids.distinct(), "subject", "left_semi"))
    return _batch(ids, "subject", found, ["predicate", "value", "timestamp"], "triples")


def osp_by_target(triples: DataFrame, targets: DataFrame) -> DataFrame:
    """(obj_ref, sources) for each target asked for."""
    found = triples.filter(F.col("obj_type") == REF).join(targets.distinct(), "obj_ref", "left_semi")
    return _batch(targets, "obj_ref", found, ["subject", "predicate"], "sources")


def prefixed(triples: DataFrame, prefix: str) -> DataFrame:
    """Triples of the subjects that begin with ``prefix``; an empty one gives all."""
    return triples.filter(F.startswith("subject", F.lit(prefix))) if prefix else triples


def insert(triples: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new rows appended; columns that they lack are null."""
    return triples.unionByName(new, allowMissingColumns=True)


def upsert(triples: DataFrame, changes: DataFrame, timestamp: Column) -> DataFrame:
    """New versions: (subject, predicate, obj_type, value columns) stamped and appended."""
    return insert(triples, changes.withColumn("timestamp", timestamp))


def retract(triples: DataFrame, keys: DataFrame, timestamp: Column) -> DataFrame:
    """Tombstones of the (subject, predicate) pairs that exist, appended."""
    gone = triples.join(keys.select("subject", "predicate").distinct(), ["subject", "predicate"], "left_semi").select("subject", "predicate").distinct()
    return insert(triples, gone.select("subject", "predicate", *_object(NULL, None, ""), timestamp.alias("timestamp")))


def exists(triples: DataFrame) -> DataFrame:
    """(subject, predicate) pairs that have a live value."""
    return alive(triples).select("subject", "predicate").distinct()


def first_values(triples: DataFrame, predicate: str) -> DataFrame:
    """(subject, value): the least live value of a predicate."""
    return value_text(alive(triples.filter(F.col("predicate") == predicate))).groupBy("subject").agg(F.min("value").alias("value"))


def predicate_stats(triples: DataFrame, predicate: str) -> DataFrame:
    """count of the subjects that have the predicate; sum and avg of the values that are numbers."""
    values = first_values(triples, predicate)
    number = F.col("value").try_cast("double")
    return values.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(number), F.lit(0.0)).alias("sum"), F.coalesce(F.avg(number), F.lit(0.0)).alias("avg"))


def spo_batch(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """Latest triples of many subjects (column ``subject`` of ids)."""
    return alive(triples.join(ids, "subject", "left_semi"))


_OPS = {"=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "contains": lambda c, v: F.contains(c, v)}


def _home(value: object) -> Column:
    if isinstance(value, bool):
        return F.col("obj_bool")
    if isinstance(value, (int, float)):
        return F.coalesce(F.col("obj_int64").cast("double"), F.col("obj_float64"))
    return F.col("obj_string")


def pos(triples: DataFrame, predicate: str, op: str | None = None, value: object = None) -> DataFrame:
    """Rows of a predicate, and of a value compared within its own family only."""
    rows = triples.filter(F.col("predicate") == predicate)
    return rows if op is None else rows.filter(_OPS[op](_home(value), F.lit(value)))


def value_filter(triples: DataFrame, predicate: str, op: str, value: object) -> DataFrame:
    """Subjects whose latest live value passes."""
    return pos(alive(triples.filter(F.col("predicate") == predicate)), predicate, op, value).select("subject").distinct()


def osp(triples: DataFrame, target: str, predicate: str | None = None) -> DataFrame:
    """Triples that refer to ``target``."""
    rows = triples.filter((F.col("obj_type") == REF) & (F.col("obj_ref") == target))
    return rows if predicate is None else rows.filter(F.col("predicate") == predicate)


def value_text(triples: DataFrame) -> DataFrame:
    return triples.withColumn("value", F.coalesce("obj_ref", "obj_string", *[F.col(c).cast("string") for c in ("obj_int64", "obj_float64", "obj_bool", "obj_timestamp")]))


def entities(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """A row per subject with the named predicates as arrays of text."""
    named = value_text(triples.filter(F.col("predicate").isin(predicates)))
    return named.groupBy("subject").pivot("predicate", predicates).agg(F.sort_array(F.collect_list("value")))


def counts(triples: DataFrame) -> DataFrame:
    return triples.agg(F.count_distinct("subject").alias("n_entities"), F.count(F.lit(1)).alias("n_triples"))


def postings(triples: DataFrame, key: str = "obj_ref", chunks: int = 1) -> DataFrame:
    """Subjects by (predicate, key) as sorted sets; a set in so many chunks, by a hash of the subject, that hot keys fit."""
    chunk = F.pmod(F.xxhash64("subject"), F.lit(chunks)).cast("int").alias("chunk")
    return triples.filter(F.col(key).isNotNull()).groupBy("predicate", key, chunk).agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
