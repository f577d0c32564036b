"""What the compiler knows: entity tables by type and edge views by predicate.

Entities stay in their wide tables, so filters and projections reach the Parquet scan;
an edge view is a projection of the table that holds the foreign key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "https://tpch.example.com/"


@dataclass(frozen=True)
class EntityType:
    name: str
    load: Callable[[], DataFrame]
    key: str


@dataclass(frozen=True)
class EdgeType:
    predicate: str
    src: str
    dst: str
    load: Callable[[], DataFrame]
    #: Column of the table of ``src`` that names ``dst``, where the edge lives in that table: each ``src`` has one.
    column: str = ""


@dataclass
class Catalog:
    entities: dict[str, EntityType] = field(default_factory=dict)
    edge_types: dict[str, EdgeType] = field(default_factory=dict)

    def entity(self, kind: str) -> DataFrame:
        """The table of a type with its key as ``key``."""
        e = self.entities[kind]
        return e.load().withColumn("key", F.col(e.key))

    def edges(self, predicate: str) -> DataFrame:
        return self.edge_types[predicate].load()


def iri(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{BASE}{kind}/"), key.cast("string"))


TURN = 10_000


def star_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The star schema as a graph."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    c = Catalog()
    for kind, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")):
        c.entities[kind] = EntityType(kind, lambda t=kind: read(t), key)
    c.entities["order"] = EntityType("order", lambda: read("orders"), "o_orderkey")
    c.entities["turn"] = EntityType("turn", lambda: read("conversations").withColumn("turn_key", F.col("conv_id") * TURN + F.col("turn")), "turn_key")

    def edge(predicate: str, src: str, dst: str, table: str, a: str, b: str, distinct: bool = False, own: bool = False) -> None:
        def load() -> DataFrame:
            e = read(table).select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst"))
            return e.distinct() if distinct else e

        c.edge_types[predicate] = EdgeType(predicate, src, dst, load, b if own else "")

    edge("inRegion", "nation", "region", "nation", "n_nationkey", "n_regionkey", own=True)
    edge("inNation", "customer", "nation", "customer", "c_custkey", "c_nationkey", own=True)
    edge("supplierNation", "supplier", "nation", "supplier", "s_suppkey", "s_nationkey", own=True)
    edge("placedBy", "order", "customer", "orders", "o_orderkey", "o_custkey", own=True)
    edge("containsPart", "order", "part", "lineitem", "l_orderkey", "l_partkey")
    edge("suppliedBy", "order", "supplier", "lineitem", "l_orderkey", "l_suppkey")
    edge("supplies", "supplier", "part", "lineitem", "l_suppkey", "l_partkey", True)

    def following() -> DataFrame:
        t = read("conversations").select((F.col("conv_id") * TURN + F.col("turn")).alias("src"))
        return t.join(t.select(F.col("src").alias("dst")), F.col("dst") == F.col("src") + 1)

    c.edge_types["next"] = EdgeType("next", "turn", "turn", following)
    return c
