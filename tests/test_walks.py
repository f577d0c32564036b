"""Walks against brute force, where SQL over whole tables would be too slow."""

import pytest

from arbora.operators import traverse
from arbora.queries import QUERIES


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """Supplier 1 shares part 7 with supplier 50 only, and that one part 8 with supplier 60."""
    folder = tmp_path_factory.mktemp("chain")
    rows = [(1, 7), (50, 7), (50, 8), (60, 8), (60, 9), (2, 9), (1, 7)]
    spark.createDataFrame([(1, p, s) for s, p in rows], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    return folder, rows


def test_cyclic_walk_takes_edges_of_every_supplier(spark, chain):
    folder, rows = chain
    near: dict[int, set[int]] = {}
    for s, p in rows:
        near.setdefault(s * 2, set()).add(p * 2 + 1)
        near.setdefault(p * 2 + 1, set()).add(s * 2)
    want, frontier = {2: 0}, {2}
    for depth in (1, 2, 3):
        frontier = {y for x in frontier for y in near[x]} - want.keys()
        want.update(dict.fromkeys(frontier, depth))
    assert {r["key"]: r["depth"] for r in QUERIES["recurse_cyclic_all_edges"](spark, str(folder)).collect()} == want
    assert 2 * 50 in want and 2 * 8 + 1 in want


def test_capped_walk_ranks_the_edges_of_its_frontier_only(spark, chain):
    df = QUERIES["lake_traversal_capped"](spark, str(chain[0]))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    for part in plan.split("Window [row_number")[1:]:
        assert "LeftSemi" in part.split("Window [row_number")[0]
    assert plan.index("Aggregate [src") < plan.rindex("LeftSemi")  # edges are cut before they are made distinct
    assert sorted(r["key"] for r in df.collect()) == [2, 4, 100, 120]


def test_capped_walk_against_brute_force(spark):
    edges = sorted({(s % 40, s * 7919 % 97) for s in range(600)})
    want = [1, 1, 2, 5]
    for cap in (6, 9):
        want = sorted({d for s in set(want) for d in [d for a, d in edges if a == s][:3]})[:cap]
    start = spark.createDataFrame([(k,) for k in (1, 1, 2, 5)], "key long")
    got = traverse.capped_walk(start, spark.createDataFrame(edges, "src long, dst long"), 2, 3, 6, 9)
    assert [r["key"] for r in got.collect()] == want
