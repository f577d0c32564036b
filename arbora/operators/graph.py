"""A graph to read and change: entities as triples, traversals, batches, and patterns of hops.

Changes never rewrite: they append versions or tombstones, and reads take the latest.  Each
method returns a lazy DataFrame, or a new ``Graph`` for a change; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators import traverse, triples
from arbora.operators.triples import BOOL, FLOAT64, INT64, REF, STRING

LIMIT = 100
MOST_OPERATIONS = 1000


def _cell(value: object) -> tuple:
    """(obj_type, obj_ref, obj_string, obj_int64, obj_float64, obj_bool) of a Python value; ``{"@ref": id}`` refers."""
    if isinstance(value, dict) and "@ref" in value:
        return (REF, value["@ref"], None, None, None, None)
    if isinstance(value, bool):
        return (BOOL, None, None, None, None, value)
    if isinstance(value, int):
        return (INT64, None, None, value, None, None)
    if isinstance(value, float):
        return (FLOAT64, None, None, None, value, None)
    return (STRING, None, str(value), None, None, None)


_ROWS = "subject string, predicate string, obj_type int, obj_ref string, obj_string string, obj_int64 long, obj_float64 double, obj_bool boolean"


@dataclass(frozen=True)
class Graph:
    """``rows`` is the log of triples; ``now`` stamps changes and rises with each."""

    rows: DataFrame
    now: int = 1
    errors: tuple[tuple[int, str], ...] = field(default=())

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def _written(self, entities: list[tuple[str, dict]]) -> DataFrame:
        cells = [(key, name, *_cell(v)) for key, props in entities for name, value in props.items() for v in (value if isinstance(value, list) else [value]) if v is not None]
        return self.spark.createDataFrame(cells, _ROWS).withColumn("obj_timestamp", F.lit(None).cast("long"))

    # reading
    def live(self) -> DataFrame:
        return triples.alive(self.rows)

    def get(self, *keys: str) -> DataFrame:
        """(subject, type, props): a row for each key, its properties as a map of arrays of text; null where it is unknown."""
        asked = self.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "subject string")
        found = triples.value_text(triples.alive(self.rows.filter(F.col("subject").isin(*keys))))
        values = found.groupBy("subject", "predicate").agg(F.sort_array(F.collect_list("value")).alias("vs"))
        props = values.groupBy("subject").agg(
            F.coalesce(F.max(F.when(F.col("predicate") == "$type", F.get("vs", F.lit(0)))), F.lit("Thing")).alias("type"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("predicate", "vs")))).alias("props"),
        )
        return asked.join(props, "subject", "left")

    def _where(self, rows: DataFrame, equal: dict[str, object] | None) -> DataFrame:
        """Keys whose latest values equal all of ``equal``; applied before any limit."""
        for name, value in (equal or {}).items():
            rows = rows.join(triples.value_filter(self.rows, name, "=", value).select(F.col("subject").alias("key")), "key", "left_semi")
        return rows

    def edges(self, predicate: str) -> DataFrame:
        kept = triples.alive(self.rows.filter(F.col("predicate") == predicate)).filter(F.col("obj_type") == REF)
        return kept.select(F.col("subject").alias("src"), F.col("obj_ref").alias("dst"))

    def _start(self, *keys: str) -> DataFrame:
        return self.spark.createDataFrame([(k,) for k in keys], "key string")

    def traverse(self, key: str, predicate: str, equal: dict[str, object] | None = None, limit: int = LIMIT, reverse: bool = False) -> DataFrame:
        """Keys one hop on (or back), filtered, then the first ``limit`` by key."""
        return self._where(traverse.hop(self._start(key), self.edges(predicate), reverse), equal).orderBy("key").limit(limit)

    def reverse_traverse(self, key: str, predicate: str, equal: dict[str, object] | None = None, limit: int = LIMIT) -> DataFrame:
        return self.traverse(key, predicate, equal, limit, reverse=True)

    def path(self, key: str, predicates: list[str], limit: int = LIMIT) -> DataFrame:
        return traverse.path(self._start(key), [self.edges(p) for p in predicates]).orderBy("key").limit(limit)

    # changing
    def _taken(self, keys: list[str]) -> set[str]:
        rows = triples.alive(self.rows.filter(F.col("subject").isin(*keys))).select("subject").distinct()
        return {r["subject"] for r in rows.collect()}  # as many rows as keys at most

    def create(self, key: str, props: dict) -> Graph:
        if self._taken([key]):
            raise ValueError(f"{key} exists")
        return self.update(key, props)

    def update(self, key: str, props: dict) -> Graph:
        """New versions of the properties given; others stay."""
        return Graph(triples.upsert(self.rows, self._written([(key, props)]), F.lit(self.now).cast("long")), self.now + 1)

    def delete(self, key: str) -> Graph:
        """Tombstones for every property."""
        keys = self.spark.createDataFrame([(key,)], "subject string")
        return Graph(self.rows.unionByName(triples.tombstones(self.rows, keys, F.lit(self.now).cast("long")), allowMissingColumns=True), self.now + 1)

    def execute(self, operations: list[tuple[str, str, dict]]) -> Graph:
        """Changes (create, update or delete; key; properties) as one append; ``errors`` has (index, message) of those refused."""
        if len(operations) > MOST_OPERATIONS:
            raise ValueError(f"a batch has {MOST_OPERATIONS} operations at most")
        taken, errors, state = self._taken([k for _, k, _ in operations]), [], self.rows
        written: list[tuple[int, str, dict]] = []
        gone: list[tuple[int, str]] = []
        for i, (op, key, props) in enumerate(operations):
            if op == "create" and key in taken:
                errors.append((i, f"{key} exists"))
            elif op in ("create", "update"):
                taken.add(key)
                written.append((i, key, props))
            elif op == "delete" and key in taken:
                taken.discard(key)
                gone.append((i, key))
            else:
                errors.append((i, f"{key} is unknown" if op == "delete" else f"unknown operation {op}"))
        for i, key, props in written:
            state = state.unionByName(self._written([(key, props)]).withColumn("timestamp", F.lit(self.now + i).cast("long")), allowMissingColumns=True)
        if gone:
            at = self.spark.createDataFrame(gone, "stamp long, subject string")
            marks = state.join(F.broadcast(at), "subject").filter(F.col("timestamp") < self.now + F.col("stamp"))
            marks = marks.groupBy("subject", "predicate").agg(F.max("stamp").alias("stamp"))
            marks = marks.select("subject", "predicate", *triples._object(triples.NULL, None, ""), (self.now + F.col("stamp")).cast("long").alias("timestamp"))
            state = state.unionByName(marks, allowMissingColumns=True)
        return Graph(state, self.now + len(operations), tuple(errors))


@dataclass(frozen=True)
class Step:
    """A hop of a pattern: ``least`` to ``most`` repeats of a predicate, forward or back."""

    predicate: str
    reverse: bool = False
    least: int = 1
    most: int = 1


def match(catalog, kind: str, where: Column | None, steps: list[Step], then: Column | None = None, fields: list[str] | None = None, keys: list | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the entities at the end of a pattern of hops, each once.

    ``kind`` and ``where`` (or ``keys``) choose where it starts; ``then`` filters the entities at its end,
    ``fields`` are those wanted.  Repeats follow one predicate, so both ends of such an edge have one type.
    """
    start = catalog.entity(kind)
    start = start if where is None else start.filter(where)
    start = start if keys is None else start.filter(F.col("key").isin(*keys))
    at = start.select(F.col("key").cast("long").alias("key"))
    for step in steps:
        edge = catalog.edge_types[step.predicate]
        links = catalog.edges(step.predicate)
        if step.reverse:
            links = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        if (step.least, step.most) == (1, 1):
            at = traverse.hop(at, links)
        else:
            walked = traverse.bag_walk(at, links, max(1, step.least), step.most).select("key")
            at = (walked.unionByName(at) if step.least == 0 else walked).distinct()
        kind = edge.src if step.reverse else edge.dst
    end = catalog.entity(kind)
    end = (end if then is None else end.filter(then)).join(at, "key", "left_semi")
    out = end.select("key", *(fields or []))
    return out if limit is None else out.orderBy("key").limit(limit)
