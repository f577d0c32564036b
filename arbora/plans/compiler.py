"""Path queries to lazy DataFrames.

A hop is one equi-join with an edge view and a distinct.  Where an edge lives in the table of the
entities it comes from, a reverse hop is a semi-join of that table: hop, filter and fields share one
scan, and no distinct is needed.  Filters reach the scan.  A missing field makes ``!=`` true and
all other comparisons false; values of different families are unequal and never cast.  Limits
come last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.operators.traverse import bounded_walk
from arbora.plans.catalog import Catalog
from arbora.plans.syntax import Compare, Entity, Expand, Field, Filter, Hop, Logic, PathSyntaxError, Recurse, parse


@dataclass
class Frontier:
    """Entities reached: their type and keys, the last hop, and their table's rows where these are at hand."""

    kind: str
    keys: DataFrame
    last: str = ""
    reverse: bool = False
    rows: DataFrame | None = None


def family(dtype: T.DataType | object) -> str:
    if isinstance(dtype, (bool, T.BooleanType)):
        return "bool"
    if isinstance(dtype, (int, float, T.NumericType)):
        return "number"
    return "string" if isinstance(dtype, (str, T.StringType)) else "other"


def compare(schema: T.StructType, c: Compare) -> Column:
    unlike = c.op == "!="
    if c.field not in schema.fieldNames() or family(schema[c.field].dataType) != family(c.value):
        return F.lit(unlike)
    column, value = F.col(c.field), F.lit(c.value)
    tested = {"=": column == value, "!=": column != value, "<": column < value, ">": column > value, "<=": column <= value, ">=": column >= value}[c.op]
    return F.coalesce(tested, F.lit(True)) if unlike else tested


def condition(schema: T.StructType, node: object) -> Column:
    if isinstance(node, Compare):
        return compare(schema, node)
    assert isinstance(node, Logic)
    left, right = condition(schema, node.left), condition(schema, node.right)
    return left & right if node.op == "and" else left | right


def _key(table: DataFrame) -> Column:
    whole = isinstance(table.schema["key"].dataType, T.IntegralType)
    return (F.col("key").cast("long") if whole else F.col("key")).alias("key")


def _identified(table: DataFrame, text: str) -> DataFrame:
    """Rows of an id: the literal takes the key's type; one that can't is nobody's."""
    if not isinstance(table.schema["key"].dataType, T.NumericType):
        return table.filter(F.col("key") == F.lit(text))
    whole = text.isascii() and text.lstrip("-").isdigit() and abs(int(text)) < 2**63
    return table.filter(F.col("key") == F.lit(int(text))) if whole else table.filter(F.lit(False))


def _hop(catalog: Catalog, at: Frontier, predicate: str, reverse: bool) -> Frontier:
    edge = catalog.edge_types[predicate]
    if reverse and edge.column:
        near = at.keys.select(F.col("key").alias("_near"))
        rows = catalog.entity(edge.src)
        rows = rows.join(near, F.col(edge.column) == F.col("_near"), "left_semi")
        return Frontier(edge.src, rows.select(_key(rows)), predicate, reverse, rows)
    near, far = ("dst", "src") if reverse else ("src", "dst")
    keys = at.keys.join(catalog.edges(predicate), F.col("key") == F.col(near)).select(F.col(far).alias("key")).distinct()
    return Frontier(edge.src if reverse else edge.dst, keys, predicate, reverse)


def _expand(catalog: Catalog, kind: str, keys: DataFrame, fields: tuple[Field, ...], rows: DataFrame | None = None) -> DataFrame:
    """``key`` and the named fields; a predicate becomes an array of what it leads to."""
    table = catalog.entity(kind)
    plain = [f.name for f in fields if f.name in table.columns]
    out = (table.join(keys, "key", "left_semi") if rows is None else rows).select("key", *plain)
    for f in fields:
        edge = catalog.edge_types.get(f.name)
        if f.name in table.columns or edge is None or edge.src != kind:
            continue
        links = catalog.edges(f.name).join(keys, F.col("src") == F.col("key"), "left_semi")
        inner = _expand(catalog, edge.dst, links.select(F.col("dst").alias("key")).distinct(), f.nested or (Field("key"),))
        names = [c for c in inner.columns if c != "key"] or ["key"]
        listed = links.join(inner, F.col("dst") == F.col("key")).groupBy("src").agg(F.collect_list(F.struct(*names)).alias(f.name))
        out = out.join(listed, F.col("key") == F.col("src"), "left").drop("src")
    return out


def compile_node(catalog: Catalog, node: object) -> Frontier:
    if isinstance(node, Entity):
        rows = _identified(catalog.entity(node.namespace), node.id)
        return Frontier(node.namespace, rows.select(_key(rows)), rows=rows)
    at = compile_node(catalog, node.source)
    if isinstance(node, Hop):
        return _hop(catalog, at, node.predicate, node.reverse)
    if isinstance(node, Filter):
        table = catalog.entity(at.kind)
        rows = (table.join(at.keys, "key", "left_semi") if at.rows is None else at.rows).filter(condition(table.schema, node.condition))
        return Frontier(at.kind, rows.select(_key(rows)), at.last, at.reverse, rows)
    if isinstance(node, Recurse):
        edges = catalog.edges(at.last)
        if at.reverse:
            edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        walked = bounded_walk(at.keys.select("key"), edges, node.depth - 1)
        levels = walked.filter(F.col("depth") == node.depth - 1) if node.exact else walked
        return Frontier(at.kind, levels.select("key"), at.last, at.reverse)
    raise TypeError(f"{type(node).__name__} ends a query")


def _check(catalog: Catalog, node: object, text: str) -> None:
    """Names that the catalog doesn't have are errors with a position."""
    while not isinstance(node, Entity):
        if isinstance(node, Hop) and node.predicate not in catalog.edge_types:
            raise PathSyntaxError(f"unknown predicate {node.predicate!r}", text, max(0, text.find(node.predicate)))
        node = node.source
    if node.namespace not in catalog.entities:
        raise PathSyntaxError(f"unknown entity type {node.namespace!r}", text, max(0, text.find(node.namespace)))


def run(catalog: Catalog, text: str, limit: int | None = None) -> DataFrame:
    """Rows of a path query: the wanted fields, or the keys of the last frontier."""
    node = parse(text)
    _check(catalog, node, text)
    if isinstance(node, Expand):
        at = compile_node(catalog, node.source)
        out = _expand(catalog, at.kind, at.keys, node.fields, at.rows).drop("key")
    else:
        out = compile_node(catalog, node).keys
    return out if limit is None else out.limit(limit)
