"""Traversals: joins of a frontier with an edge view.

Walks loop on the driver over lazy joins; each frontier is written to the shared checkpoint
folder once, which cuts the lineage and survives a lost executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.sources.files import shared_folder

#: Frontiers after which what was visited is written as one table, so that plans stay small.
CUT_EVERY = 8


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that the cluster shares."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def hop(frontier: DataFrame, edges: DataFrame, reverse: bool = False, distinct: bool = True) -> DataFrame:
    """Keys one hop on; a bag unless ``distinct``."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    out = frontier.join(edges, F.col("key") == F.col(near)).select(F.col(far).alias("key"))
    return out.distinct() if distinct else out


def path(frontier: DataFrame, steps: list[DataFrame], distinct: bool = True) -> DataFrame:
    """The last frontier of a chain of hops."""
    for edges in steps:
        frontier = hop(frontier, edges, distinct=distinct)
    return frontier


def bounded_walk(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(key, depth): everything within ``depth`` hops at its least depth, the start at 0."""
    visited = cut(start.distinct().withColumn("depth", F.lit(0)))
    frontier = visited.select("key")
    for level in range(1, depth + 1):
        frontier = cut(hop(frontier, edges).join(visited.select("key"), "key", "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.withColumn("depth", F.lit(level)))
        if level % CUT_EVERY == 0:
            visited = cut(visited)
    return visited


def bag_walk(start: DataFrame, edges: DataFrame, least: int, most: int) -> DataFrame:
    """(key, depth) for every walk of ``least`` to ``most`` hops, repeats kept."""
    level, out = start.select("key"), None
    for depth in range(1, most + 1):
        level = hop(level, edges, distinct=False)
        if depth >= least:
            rows = level.withColumn("depth", F.lit(depth))
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else start.select("key", F.lit(0).alias("depth")).limit(0)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def capped_walk(start: DataFrame, edges: DataFrame, depth: int, per_source: int, frontier_cap: int, final_cap: int) -> DataFrame:
    """A walk whose feature is its caps: the first edges of each source, the first keys of each frontier.

    Edges are cut to those of the frontier before they are ranked, so that a level ranks what its frontier has, not the table.
    """
    order = Window.partitionBy("src").orderBy("dst")
    frontier = start.select("key")
    for level in range(depth):
        cap = final_cap if level == depth - 1 else frontier_cap
        own = edges.join(frontier, F.col("src") == F.col("key"), "left_semi")
        first = own.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_source)
        frontier = first.select(F.col("dst").alias("key")).distinct().orderBy("key").limit(cap)
    return frontier


def neighbours(start: DataFrame, edges: dict[str, DataFrame], direction: str = "out") -> DataFrame:
    """(predicate, key) of all neighbours by the named predicates; direction out, in or both."""
    out = None
    for predicate, e in edges.items():
        for reverse in {"out": (False,), "in": (True,), "both": (False, True)}[direction]:
            rows = hop(start, e, reverse).withColumn("predicate", F.lit(predicate))
            out = rows if out is None else out.unionByName(rows)
    return out.select("predicate", "key").distinct()
