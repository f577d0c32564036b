"""Typed objects as JSON strings and back, with Spark's own JSON functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.operators.triples import BOOL, DATE, DURATION, FLOAT64, INT32, INT64, NULL, REF, STRING, TIMESTAMP, URL

_TEXT = (STRING, DATE, DURATION, URL)


def to_json(wrap_refs: bool = False) -> Column:
    """``{"type", "value"}`` of the object columns; 64-bit integers are strings, as JSON numbers lose digits.

    ``wrap_refs`` writes references as ``{"@ref": ...}``.  A null object has no value.
    """
    kind = F.col("obj_type")
    written = lambda value: F.to_json(F.struct(kind.alias("type"), value.alias("value")))
    ref = F.struct(F.col("obj_ref").alias("@ref")) if wrap_refs else F.col("obj_ref")
    return (
        F.when(kind == BOOL, written(F.col("obj_bool")))
        .when(kind.isin(INT32, INT64), written(F.col("obj_int64").cast("string")))
        .when(kind == FLOAT64, written(F.col("obj_float64")))
        .when(kind == TIMESTAMP, written(F.col("obj_timestamp").cast("string")))
        .when(kind == REF, written(ref))
        .when(kind.isin(*_TEXT), written(F.col("obj_string")))
        .when(kind == NULL, F.to_json(F.struct(kind.alias("type"))))
    )


def from_json(text: Column) -> Column:
    """Struct of the object columns; null where the text is no such object."""
    kind = F.get_json_object(text, "$.type").try_cast("int")
    value = F.get_json_object(text, "$.value")
    of = lambda *kinds: F.when(kind.isin(*kinds), value)
    ref = F.coalesce(F.get_json_object(text, "$.value['@ref']"), value)
    return F.when(
        kind.isNotNull(),
        F.struct(
            kind.alias("obj_type"), F.when(kind == REF, ref).alias("obj_ref"), of(*_TEXT).alias("obj_string"), of(INT32, INT64).try_cast("long").alias("obj_int64"),
            of(FLOAT64).try_cast("double").alias("obj_float64"), of(BOOL).try_cast("boolean").alias("obj_bool"), of(TIMESTAMP).try_cast("long").alias("obj_timestamp"),
        ),
    )
