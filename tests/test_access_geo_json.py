import pytest
from pyspark.sql import functions as F

from arbora.functions import geo, typed_json
from arbora.operators import access


def test_decode_known_cell_and_bad_hashes(spark):
    df = spark.createDataFrame([("ezs42",), ("EZS42",), ("",), ("a",), (None,)], "g string")
    got = [r["at"] for r in df.select(geo.decode(F.col("g")).alias("at")).collect()]
    assert [round(v, 3) for v in got[0]] == [42.605, -5.603]
    assert got[1] == got[0] and got[2:] == [None] * 3


@pytest.mark.parametrize("length", [1, 5, 6, 9, 12])
def test_cells_return_to_the_hash(spark, length):
    df = spark.createDataFrame([(48.137, 11.575), (-90.0, -180.0), (90.0, 180.0), (0.0, 0.0)], "lat double, lng double")
    g = df.select(geo.geohash(F.col("lat"), F.col("lng"), length).alias("g"))
    c = geo.cells(F.col("g"))
    assert all(a == b for a, b in g.select("g", geo.cells_to_geohash(c["x"], c["y"], c["length"])).collect())


@pytest.mark.parametrize("length", [1, 2, 7, 12, 15])
def test_letters_of_cells_bit_by_bit(spark, length):
    """Odd and even numbers of bits, and more than one long holds, against interleaving by hand."""
    spots = [(48.137, 11.575), (-90.0, -180.0), (90.0, 180.0), (-33.9, 151.2), (0.0, -0.001)]
    df = spark.createDataFrame(spots, "lat double, lng double").select(geo.geohash(F.col("lat"), F.col("lng"), length).alias("g"))
    total = length * 5
    nx, ny = (total + 1) // 2, total // 2
    for (lat, lng), (g,) in zip(spots, df.collect(), strict=True):
        x, y = min(int((lng + 180) / 360 * 2**nx), 2**nx - 1), min(int((lat + 90) / 180 * 2**ny), 2**ny - 1)
        bits = "".join(f"{x:0{nx}b}"[k // 2] if k % 2 == 0 else f"{y:0{ny}b}"[k // 2] for k in range(total))
        assert g == "".join(geo.BASE32[int(bits[k : k + 5], 2)] for k in range(0, total, 5))


def test_plans_of_cells_stay_small(spark):
    """A geohash is named once in what is worked out from it, so that no row works it out again for each bit."""
    df, g = spark.range(1), F.upper(geo.geohash(F.col("id") * 1.0, F.col("id") * 2.0, 6))
    for made in (geo.decode(g), geo.neighbours(g), geo.neighbours(g, wrap=False)):
        assert df.select(made.alias("m"))._jdf.queryExecution().analyzed().toString().count("id#") <= 4


def test_neighbours_at_the_edge(spark):
    df = spark.createDataFrame([("0",), (None,), ("!",)], "g string")
    wrapped = [r[0] for r in df.select(geo.neighbours(F.col("g"))).collect()]
    on_map = [r[0] for r in df.select(geo.neighbours(F.col("g"), wrap=False)).collect()]
    assert wrapped == [["2", "3", "1", "1", "0", "p", "p", "r"], None, None]
    assert on_map == [["0", "2", "3", "1"], None, None]


def test_namespaces(spark):
    df = spark.createDataFrame([("a/b",), ("b",), (None,)], "ns string")
    seen = lambda allowed: df.filter(access.in_namespaces(F.col("ns"), allowed)).count()
    assert [seen(["*"]), seen(["a"]), seen([]), seen(["a/b", "b"])] == [3, 1, 0, 2]


def test_access_lists(spark):
    acl = spark.createDataFrame([(1, "me", None, None, None), (2, "x", ["me"], None, None), (3, "x", [], ["me"], False), (4, "x", [], [], True), (5, None, None, None, None)], "k int, owner string, writers array<string>, readers array<string>, public boolean")
    df = spark.createDataFrame([(k,) for k in range(1, 7)], "k int")
    see = lambda p: {r["k"] for r in access.visible(df, acl, "k", "me", p).collect()}
    assert see("read") == {1, 2, 3, 4, 6} and see("write") == {1, 2, 6}
    with pytest.raises(ValueError):
        access.may("me", "delete")


def test_typed_json_reads_what_it_writes(spark):
    rows = [(0, None, None, None, None, None, None), (1, None, None, None, None, True, None), (3, None, None, 2**62 + 1, None, None, None), (4, None, None, None, 0.1, None, None), (5, None, 'say "hi"', None, None, None, None), (7, None, None, None, None, None, 1700000000000), (10, "https://e.x/1", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "obj_type int, obj_ref string, obj_string string, obj_int64 long, obj_float64 double, obj_bool boolean, obj_timestamp long")
    for wrap in (False, True):
        back = df.select(typed_json.from_json(typed_json.to_json(wrap)).alias("o")).select("o.*")
        assert [tuple(r) for r in back.collect()] == rows
    bad = spark.createDataFrame([("{",), ("[]",), (None,)], "t string")
    assert [r[0] for r in bad.select(typed_json.from_json(F.col("t"))).collect()] == [None] * 3
