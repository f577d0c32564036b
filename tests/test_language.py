import pytest

from arbora.operators import combine, search, traverse
from arbora.plans.catalog import Catalog, EdgeType, EntityType, star_catalog
from arbora.plans.compiler import run
from arbora.plans.syntax import PathSyntaxError, count_hops, parse, stringify


@pytest.mark.parametrize("text", [
    "order:77", 'supplier:"north-7b"', "order:77.placedBy.inNation", "part:9 <- containsPart", "nation:4 <- inNation <- placedBy*[depth = 2]",
    'nation:4 <- inNation[?(c_acctbal <= 10.5 or c_mktsegment != "AUTOMOBILE") and c_name > "C"]', "region:0 <- inRegion { n_name, inRegion { r_name } }", "turn:30000.next*[depth <= 7]",
])
def test_round_trip(text):
    node = parse(text)
    assert parse(stringify(node)) == node


@pytest.mark.parametrize("text", ["", "order", "order:5[?o_totalprice > 9", "part:3{p_name", "part:3 <-", "nation:2 { }", "nation:2 8", "turn:1.next*[depth > 4]", "turn:1*", "turn:1{" + "next{" * 60])
def test_refused(text):
    with pytest.raises(PathSyntaxError):
        parse(text)


def test_hops_and_position():
    assert count_hops(parse("turn:1.next.next*[depth <= 6]")) == 7
    with pytest.raises(PathSyntaxError, match="line 3, column 6"):
        parse("turn:1\n\n.next]")


def test_cursor():
    token = combine.cursor("q", 7, 10, now=0)
    assert combine.read_cursor(token, "q", now=10) == (7, 10)
    for bad in ((token, "other", 10), (token, "q", 9999), ("nonsense", "q", 0)):
        with pytest.raises(ValueError):
            combine.read_cursor(*bad)


def test_cyclic_walk(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "key long")
    assert {tuple(r) for r in traverse.bounded_walk(start, edges, 10).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_radius_across_antimeridian(spark):
    places = spark.createDataFrame([(1, 0.0, 179.9), (2, 0.0, -179.9), (3, 0.0, 0.0), (4, 90.0, 10.0)], "id long, lat double, lng double")
    near = search.within_radius(places, "lat", "lng", (0.0, 179.95), 50)
    assert {r["id"] for r in near.collect()} == {1, 2}
    assert {r["id"] for r in search.within_radius(places, "lat", "lng", (89.9, -170.0), 50).collect()} == {4}


def test_sanitize():
    assert search.sanitize('a -- b') == "a"
    assert '"' not in search.sanitize('"open')


def test_unknown_names_have_a_position(spark):
    catalog = star_catalog(spark, "/root/testdata/sf0.001")
    for text, column in (("planet:1", 1), ("turn:1.orbits", 8)):
        with pytest.raises(PathSyntaxError, match=f"unknown .* column {column}"):
            run(catalog, text)


def test_reverse_recursion(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(6)], "src long, dst long")
    catalog = Catalog({"n": EntityType("n", lambda: spark.range(7).withColumnRenamed("id", "no"), "no")}, {"to": EdgeType("to", "n", "n", lambda: edges)})
    keys = lambda text: sorted(r["key"] for r in run(catalog, text).collect())
    assert keys("n:5 <- to*[depth <= 3]") == [2, 3, 4] and keys("n:1.to*[depth <= 3]") == [2, 3, 4] and keys("n:5 <- to*[depth = 2]") == [3]
    assert keys('n:"x1"') == [] and keys('n:"3"') == [3] and keys("n:99") == []


def test_text_keys(spark):
    catalog = Catalog({"n": EntityType("n", lambda: spark.createDataFrame([("a-1", 1), ("b", 2)], "id string, v int"), "id")})
    assert [r["v"] for r in run(catalog, 'n:"a-1" { v }').collect()] == [1]
