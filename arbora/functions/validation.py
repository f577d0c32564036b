"""Errors of triples and entities as arrays of messages, a message for each failed rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.functions import urls
from arbora.operators.triples import BOOL, DATE, DURATION, FLOAT64, INT32, INT64, JSON, NULL, REF, STRING, TIMESTAMP, URL


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def is_typed_object() -> Column:
    """Whether the object columns hold what ``obj_type`` says; a type without a column here holds nothing valid."""
    kind, text, whole = F.col("obj_type"), F.col("obj_string"), F.col("obj_int64")
    return F.coalesce(
        F.when(kind == NULL, F.lit(True)).when(kind == BOOL, F.col("obj_bool").isNotNull())
        .when(kind == INT32, whole.isNotNull() & whole.between(-(2**31), 2**31 - 1)).when(kind == INT64, whole.isNotNull())
        .when(kind == FLOAT64, _finite(F.col("obj_float64"))).when(kind.isin(STRING, JSON, DATE), text.isNotNull())
        .when(kind == TIMESTAMP, F.col("obj_timestamp") >= 0).when(kind == DURATION, urls.is_duration(text))
        .when(kind == REF, urls.is_entity_id(F.col("obj_ref"))).when(kind == URL, urls.is_url(text)),
        F.lit(False),
    )


def _listed(*errors: Column) -> Column:
    return F.array_compact(F.array(*errors))


def _absent(c: Column) -> Column:
    return c.isNull() | (c == "")


def triple_errors(subject: str = "subject", predicate: str = "predicate", timestamp: str = "timestamp", tx: str = "tx_id") -> Column:
    """Errors of a row of triples; an empty array if there are none."""
    s, p, t, x = F.col(subject), F.col(predicate), F.col(timestamp), F.col(tx)
    return _listed(
        F.when(_absent(s), "subject is required").when(~urls.is_entity_id(s), "subject is no entity id"),
        F.when(_absent(p), "predicate is required").when(F.contains(p, F.lit(":")), "predicate has a colon").when(~urls.is_predicate(p), "predicate is no identifier"),
        F.when(F.col("obj_type").isNull(), "object is required").when(~is_typed_object(), "object does not fit its type"),
        F.when(t.isNull(), "timestamp is required").when(t < 0, "timestamp is negative"),
        F.when(_absent(x), "transaction is required").when(~urls.is_transaction_id(x), "transaction is no ULID"),
    )


def entity_errors(key: Column, kind: Column, fields: list[str]) -> Column:
    """Errors of an entity: its id, its type, and field names (of the table) that hold a colon."""
    named = [F.lit(f"field {f} has a colon") for f in fields if ":" in f]
    return _listed(F.when(_absent(key), "id is required").when(~urls.is_entity_id(key), "id is no web URL"), F.when(_absent(kind), "type is required"), *named)


def is_field_name(c: Column) -> Column:
    return F.coalesce(urls.is_predicate(c), F.lit(False))


_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(ms: Column, seed: Column) -> Column:
    """A 26-character id that sorts by time; the rest comes from a hash of ``seed``, so that reruns agree."""
    digit = lambda value, shift: F.substr(F.lit(_CROCKFORD), F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    a, b = F.xxhash64(seed, F.lit(1)), F.xxhash64(seed, F.lit(2))
    return F.concat(*[digit(ms, 5 * k) for k in range(9, -1, -1)], *[digit(v, 5 * k) for v in (a, b) for k in range(8)])
