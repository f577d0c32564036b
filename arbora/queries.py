"""Named queries over the star schema and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import geo, typed_json, urls, vectors
from arbora.operators import access, combine, search, traverse, triples
from arbora.plans.catalog import BASE, iri, star_catalog
from arbora.plans.compiler import run
from arbora.sources.files import dealt, shared_folder
from arbora.streaming import cdc, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def paths(name: str, text: str, sql: str) -> None:
    query(name, sql)(lambda spark, sf: run(star_catalog(spark, sf), text))


# path language
FLAGSHIP = "region:1 <- inRegion <- inNation <- placedBy[?o_totalprice > 100000] { o_orderkey, o_totalprice }"
_CHAIN = "FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 1"
paths("path_3hop_filter", FLAGSHIP, f"SELECT o_orderkey, o_totalprice {_CHAIN} AND o_totalprice > 100000")
paths("lookup_entity", "customer:7 { c_name, c_acctbal }", "SELECT c_name, c_acctbal FROM customer WHERE c_custkey = 7")
paths("filter_and_or", 'region:1 <- inRegion <- inNation[?(c_acctbal > 5000 and c_mktsegment = "BUILDING") or c_acctbal < 0] { c_name }', "SELECT c_name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND ((c_acctbal > 5000 AND c_mktsegment = 'BUILDING') OR c_acctbal < 0)")
paths("filter_missing_neq", 'region:1 <- inRegion[?absent != "x"] { n_name }', "SELECT n_name FROM nation WHERE n_regionkey = 1")
paths("filter_strict_types", 'region:1 <- inRegion[?n_name != 5] { n_name }', "SELECT n_name FROM nation WHERE n_regionkey = 1")
paths("multi_hop_distinct", "nation:3 <- inNation <- placedBy.containsPart { p_name }", "SELECT p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey = 3)")
paths("recurse_chain", "turn:10000.next*[depth <= 3] { conv_id, turn }", "SELECT conv_id, turn FROM conversations WHERE conv_id = 1 AND turn BETWEEN 1 AND 3")
paths("recurse_exact", "turn:10000.next*[depth = 2] { conv_id, turn }", "SELECT conv_id, turn FROM conversations WHERE conv_id = 1 AND turn = 2")


@query("expand_nested", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey = 1")
def expand_nested(spark, sf):
    out = run(star_catalog(spark, sf), "region:1 <- inRegion { n_name, inRegion { r_name } }")
    return out.select("n_name", F.explode("inRegion").alias("r")).select("n_name", F.col("r.r_name").alias("r_name"))


@query("dotted_path_bag", "SELECT l_partkey AS key FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 4")
def dotted_path_bag(spark, sf):
    c = star_catalog(spark, sf)
    start = table(spark, sf, "orders").filter("o_custkey = 4").select(F.col("o_orderkey").alias("key"))
    return traverse.path(start, [c.edges("containsPart")], distinct=False)


@query("reverse_hop", "SELECT DISTINCT o_orderkey AS key FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)")
def reverse_hop(spark, sf):
    c = star_catalog(spark, sf)
    start = table(spark, sf, "customer").filter("c_nationkey = 5").select(F.col("c_custkey").alias("key"))
    return traverse.hop(start, c.edges("placedBy"), reverse=True)


def _mixed_edges(e: DataFrame) -> DataFrame:
    return traverse.undirected(e.select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst")))


_LEVELS = """
WITH e AS (SELECT DISTINCT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem),
u AS (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e),
l0 AS (SELECT CAST(2 AS BIGINT) AS key),
l1 AS (SELECT DISTINCT dst AS key FROM u JOIN l0 ON src = key),
l2 AS (SELECT DISTINCT dst AS key FROM u JOIN l1 ON src = key),
l3 AS (SELECT DISTINCT dst AS key FROM u JOIN l2 ON src = key)
SELECT key, min(depth) AS depth FROM (SELECT key, 0 AS depth FROM l0 UNION ALL SELECT key, 1 FROM l1 UNION ALL SELECT key, 2 FROM l2 UNION ALL SELECT key, 3 FROM l3) GROUP BY key"""


@query("recurse_cyclic_min_depth", _LEVELS)
def recurse_cyclic_min_depth(spark, sf):
    pairs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))  # a walk needs no distinct edges
    return traverse.bounded_walk(spark.sql("SELECT 2L AS key"), _mixed_edges(pairs), 3)


@query("recurse_cyclic_all_edges", _LEVELS)
def recurse_cyclic_all_edges(spark, sf):
    return traverse.bounded_walk(spark.sql("SELECT 2L AS key"), _mixed_edges(star_catalog(spark, sf).edges("supplies")), 3)


@query("walk_bag", """
SELECT key, depth FROM (
  SELECT conv_id * 10000 + turn + 1 AS key, 1 AS depth FROM conversations c WHERE turn = 0 AND EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = 1)
  UNION ALL
  SELECT conv_id * 10000 + turn + 2, 2 FROM conversations c WHERE turn = 0 AND EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = 2))""")
def walk_bag(spark, sf):
    c = star_catalog(spark, sf)
    start = c.entity("turn").filter("turn = 0").select("key")
    return traverse.bag_walk(start, c.edges("next"), 1, 2)


@query("lake_traversal_capped", """
WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem),
c AS (SELECT src * 2 AS src, dst * 2 + 1 AS dst FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 5
UNION ALL SELECT dst * 2 + 1, src * 2 FROM e QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) <= 5),
f AS (SELECT DISTINCT dst AS key FROM c WHERE src IN (2, 4, 6) ORDER BY key LIMIT 10)
SELECT DISTINCT dst AS key FROM c JOIN f ON src = key ORDER BY key LIMIT 20""")
def lake_traversal_capped(spark, sf):
    start = spark.sql("SELECT explode(array(2L, 4L, 6L)) AS key")
    return traverse.capped_walk(start, _mixed_edges(star_catalog(spark, sf).edges("supplies")), 2, 5, 10, 20)


@query("neighbours_both", "SELECT 'inNation' AS predicate, c_custkey AS key FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'inRegion', n_regionkey FROM nation WHERE n_nationkey = 3")
def neighbours_both(spark, sf):
    c = star_catalog(spark, sf)
    start = spark.sql("SELECT 3L AS key")
    return traverse.neighbours(start, {"inRegion": c.edges("inRegion")}, "out").unionByName(traverse.neighbours(start, {"inNation": c.edges("inNation")}, "in"))


# triples
def customer_triples(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "customer")
    return triples.melt(t, iri("customer", F.col("c_custkey")), {"c_name": "name", "c_acctbal": "balance", "c_mktsegment": "segment"}, {"inNation": iri("nation", F.col("c_nationkey"))})


_S = f"'{BASE}customer/' || c_custkey"
_N = f"'{BASE}nation/' || c_nationkey"
query("spo_scan", f"SELECT {_S} AS subject, 'name' AS predicate, c_name AS value FROM customer WHERE c_custkey = 5 UNION ALL SELECT {_S}, 'segment', c_mktsegment FROM customer WHERE c_custkey = 5 UNION ALL SELECT {_S}, 'inNation', {_N} FROM customer WHERE c_custkey = 5")(
    lambda spark, sf: triples.value_text(triples.spo(customer_triples(spark, sf), f"{BASE}customer/5")).filter("predicate != 'balance'").select("subject", "predicate", "value"))
query("lookup_batch", f"SELECT k.subject, CASE WHEN c_custkey IS NULL THEN '' ELSE 'balance=' || c_acctbal || '|inNation=' || {_N} || '|name=' || c_name || '|segment=' || c_mktsegment END AS triples FROM (SELECT unnest(['{BASE}customer/1', '{BASE}customer/2', '{BASE}customer/9999999']) AS subject) k LEFT JOIN customer ON k.subject = {_S}")(
    lambda spark, sf: triples.spo_by_subject(customer_triples(spark, sf), spark.sql(f"SELECT explode(array('{BASE}customer/1', '{BASE}customer/2', '{BASE}customer/9999999')) AS subject"))
    .select("subject", F.array_join(F.transform("triples", lambda t: F.concat(t["predicate"], F.lit("="), t["value"])), "|").alias("triples")))
query("pos_value", f"SELECT {_S} AS subject FROM customer WHERE c_mktsegment = 'BUILDING'")(
    lambda spark, sf: triples.pos(customer_triples(spark, sf), "segment", "=", "BUILDING").select("subject"))
query("pos_range", f"SELECT {_S} AS subject FROM customer WHERE c_acctbal BETWEEN 100 AND 500")(
    lambda spark, sf: triples.pos(triples.pos(customer_triples(spark, sf), "balance", ">=", 100), "balance", "<=", 500).select("subject"))
query("osp_refs", f"SELECT {_S} AS subject FROM customer WHERE c_nationkey = 3")(
    lambda spark, sf: triples.osp(customer_triples(spark, sf), f"{BASE}nation/3").select("subject"))
query("osp_by_predicate", f"SELECT {_S} AS subject FROM customer WHERE c_nationkey = 4")(
    lambda spark, sf: triples.osp(customer_triples(spark, sf), f"{BASE}nation/4", "inNation").select("subject"))
query("entity_counts", "SELECT count(*) AS n_entities, count(c_name) + count(c_acctbal) + count(c_mktsegment) + count(c_nationkey) AS n_triples FROM customer")(
    lambda spark, sf: triples.counts(customer_triples(spark, sf)))
query("materialize_entity", f"SELECT {_S} AS subject, c_name AS name, c_mktsegment AS segment, {_N} AS nation FROM customer")(
    lambda spark, sf: triples.entities(customer_triples(spark, sf), ["name", "segment", "inNation"]).select("subject", F.array_join("name", "|").alias("name"), F.array_join("segment", "|").alias("segment"), F.array_join("inNation", "|").alias("nation")))
query("postings_refs", f"SELECT {_N} AS obj_ref, count(*) AS n FROM customer GROUP BY 1")(
    lambda spark, sf: triples.postings(customer_triples(spark, sf)).select("obj_ref", F.size("subjects").cast("long").alias("n")))
for _name, _op, _sql, _value in (("eq", "=", "=", 20), ("neq", "!=", "!=", 20), ("gt", ">", ">", 40), ("lt", "<", "<", 10), ("gte", ">=", ">=", 40), ("lte", "<=", "<=", 10)):
    query(f"value_filter_{_name}", f"SELECT '{BASE}part/' || p_partkey AS subject FROM part WHERE p_size {_sql} {_value}")(
        lambda spark, sf, op=_op, value=_value: triples.value_filter(triples.melt(table(spark, sf, "part"), iri("part", F.col("p_partkey")), {"p_size": "size"}), "size", op, value))
query("value_filter_contains", f"SELECT '{BASE}part/' || p_partkey AS subject FROM part WHERE contains(p_name, 'a')")(
    lambda spark, sf: triples.value_filter(triples.melt(table(spark, sf, "part"), iri("part", F.col("p_partkey")), {"p_name": "name"}), "name", "contains", "a"))


def order_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A status triple per order, and for some a second version or a tombstone."""
    o = table(spark, sf, "orders")
    first = triples.melt(o, iri("order", F.col("o_orderkey")), {"o_orderstatus": "status"}, timestamp=F.lit(1).cast("long"))
    second = triples.melt(o.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")), iri("order", F.col("o_orderkey")), {"o_orderstatus": "status"}, timestamp=F.lit(2).cast("long"))
    gone = triples.tombstones(first, o.filter("o_orderkey % 7 = 0").select(iri("order", F.col("o_orderkey")).alias("subject")), F.lit(3).cast("long"))
    return first.unionByName(second).unionByName(gone)


query("latest_version", f"SELECT '{BASE}order/' || o_orderkey AS subject, CASE WHEN o_orderkey % 7 = 0 THEN 3 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS timestamp FROM orders")(
    lambda spark, sf: triples.latest(order_versions(spark, sf)).select("subject", "timestamp"))
query("tombstone_hidden", f"SELECT '{BASE}order/' || o_orderkey AS subject, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 != 0")(
    lambda spark, sf: triples.alive(order_versions(spark, sf)).select("subject", F.col("obj_string").alias("status")))

# aggregates, merges, pages
for _f in ("sum", "avg", "min", "max", "count"):
    query(f"agg_{_f}", f"SELECT round({_f}(c_acctbal)::DOUBLE, 4) AS value FROM customer" if _f != "count" else "SELECT count(c_acctbal) AS value FROM customer")(
        lambda spark, sf, f=_f: combine.aggregate(table(spark, sf, "customer"), "c_acctbal", f).select((F.col("value") if f == "count" else F.round("value", 4)).alias("value")))
query("agg_empty_zero", "SELECT 0.0::DOUBLE AS value")(lambda spark, sf: combine.aggregate(table(spark, sf, "customer").filter("c_custkey < 0"), "c_acctbal", "sum"))
query("group_by_value_top20", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 20")(
    lambda spark, sf: combine.top_groups(table(spark, sf, "part"), F.col("p_brand")))


def _orders(spark: SparkSession, sf: str, where: str) -> DataFrame:
    return table(spark, sf, "orders").filter(where).select("o_orderkey", "o_totalprice")


_AB = ("o_orderstatus = 'F'", "o_totalprice > 200000")
query("merge_union", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_AB[0]} OR {_AB[1]}")(lambda spark, sf: combine.merge_union([_orders(spark, sf, w) for w in _AB], "o_orderkey"))
query("merge_intersection", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_AB[0]} AND {_AB[1]}")(lambda spark, sf: combine.merge_intersection([_orders(spark, sf, w) for w in _AB], "o_orderkey"))
query("merge_ordered", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_AB[0]} OR {_AB[1]} ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")(lambda spark, sf: combine.merge_ordered([_orders(spark, sf, w) for w in _AB], "o_orderkey", "o_totalprice", True).limit(50))
query("dedupe_newest", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")(lambda spark, sf: combine.dedupe(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey"))
query("quorum", "SELECT c_custkey, c_mktsegment, 2::BIGINT AS votes FROM customer")(
    lambda spark, sf: combine.quorum((c := table(spark, sf, "customer").select("c_custkey", "c_mktsegment")).unionByName(c).unionByName(c.withColumn("c_mktsegment", F.lit("stale"))), "c_custkey", 2).select("c_custkey", "c_mktsegment", "votes"))
query("offset_page", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30")(lambda spark, sf: combine.offset_page(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 30, 10))
query("keyset_page", "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 10")(lambda spark, sf: combine.keyset_page(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100, 10))
query("latency_stats", "SELECT min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")(
    lambda spark, sf: combine.latency_stats(table(spark, sf, "events"), "value").withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)}))
query("expand_refs_left", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")(
    lambda spark, sf: combine.expand_refs(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, sf, "customer"), "c_custkey").select("o_orderkey", F.col("o_custkey_entity.c_name").alias("c_name")))

# functions
_A = r"regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')"
_SCHEME = r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
_H = rf"lower(regexp_replace({_A}, ':\d*$', ''))"
_PORT = rf"CASE WHEN ({_SCHEME} || regexp_extract({_A}, ':(\d+)$', 1)) IN ('http80', 'https443') THEN '' ELSE regexp_extract({_A}, ':(\d+)$', 1) END"
_P = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_Q = r"regexp_extract(url, '^[^?#]*(\?[^#]+)', 1)"
_FR = r"regexp_extract(url, '(#.+)$', 1)"
_R = f"array_to_string(list_reverse(string_split({_H}, '.')), ',')"
_SEGS = f"list_filter(string_split({_P}, '/'), lambda s: s != '')"
_ORIGIN = f"{_SCHEME} || '://' || {_H} || CASE WHEN {_PORT} = '' THEN '' ELSE ':' || {_PORT} END"
query("url_parts", f"SELECT page_id, {_H} AS host, {_P} AS path, regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) AS local_id FROM pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.part(F.col("url"), 3).alias("path"), urls.local_id(F.col("url")).alias("local_id")))
query("sort_key", f"SELECT page_id, {_R} || CASE WHEN {_PORT} IN ('', '80', '443') THEN '' ELSE ',:' || {_PORT} END || array_to_string(list_transform({_SEGS}, lambda s: ',/' || s), '') || CASE WHEN {_Q} = '' THEN '' ELSE ',' || {_Q} END || CASE WHEN {_FR} = '' THEN '' ELSE ',' || {_FR} END AS k FROM pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", urls.sort_key(F.col("url")).alias("k")))
query("storage_path", f"SELECT page_id, '.' || array_to_string(list_reverse(string_split({_H}, '.')), '/.') || CASE WHEN {_P} = '' THEN '/' ELSE {_P} END AS p FROM pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", urls.storage_path(F.col("url")).alias("p")))
query("namespace_of", f"SELECT page_id, {_ORIGIN} || '/' || CASE WHEN len({_SEGS}) > 1 THEN {_SEGS}[1] || '/' ELSE '' END AS ns FROM pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", urls.namespace(F.col("url")).alias("ns")))
query("validate_ids", r"""SELECT page_id, CASE WHEN url IS NULL OR trim(url) = '' THEN 'EMPTY' WHEN length(url) > 2048 THEN 'TOO_LONG' WHEN regexp_matches(url, '[\x00-\x1F\x7F\x{200B}-\x{200D}\x{FEFF}\x{AD}\x{FFFD}]') THEN 'INVALID_CHARACTERS'
WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') OR (regexp_matches(url, '^(?i)https?:') AND NOT regexp_matches(url, '^(?i)https?://[^/?#]+')) THEN 'INVALID_URL' WHEN NOT regexp_matches(url, '^(?i)https?:') THEN 'INVALID_PROTOCOL'
WHEN regexp_matches(url, '^[^/]*//([^/?#]*@)?\.\.?(:\d*)?([/?#]|$)') THEN 'INVALID_HOSTNAME' WHEN regexp_matches(url, '^[^/]*//[^/?#]*@') THEN 'HAS_USER_INFO' END AS error FROM pages""")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", urls.entity_id_error(F.col("url")).alias("error")))
query("fnv1a", "SELECT c_custkey, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(c_mktsegment, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT AS h FROM customer")(
    lambda spark, sf: table(spark, sf, "customer").select("c_custkey", vectors.fnv1a(F.col("c_mktsegment")).alias("h")))

_LAT, _LNG = "(((c_custkey * 37) % 180) - 90)::DOUBLE", "(((c_custkey * 91) % 360) - 180)::DOUBLE"


def places(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", (k * 37 % 180 - 90).cast("double").alias("lat"), (k * 91 % 360 - 180).cast("double").alias("lng"))


def _km(lat: float, lng: float) -> str:
    return f"2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians({lng} - lng) / 2), 2))))"


_PL = f"(SELECT c_custkey, {_LAT} AS lat, {_LNG} AS lng FROM customer)"
query("haversine_topk", f"SELECT c_custkey, round({_km(37.0, -122.0)}, 6) AS km FROM {_PL} ORDER BY {_km(37.0, -122.0)}, c_custkey LIMIT 10")(
    lambda spark, sf: search.nearest(places(spark, sf), "c_custkey", geo.haversine(F.col("lat"), F.col("lng"), F.lit(37.0), F.lit(-122.0)), 10).select("c_custkey", F.round("distance", 6).alias("km")))
query("geo_bbox", f"SELECT c_custkey FROM {_PL} WHERE lat BETWEEN 10 AND 30 AND lng BETWEEN -40 AND 40")(lambda spark, sf: places(spark, sf).filter(geo.in_box(F.col("lat"), F.col("lng"), 10, -40, 30, 40)).select("c_custkey"))
query("geo_bbox_antimeridian", f"SELECT c_custkey FROM {_PL} WHERE lat BETWEEN -20 AND 20 AND (lng >= 170 OR lng <= -170)")(lambda spark, sf: places(spark, sf).filter(geo.in_box(F.col("lat"), F.col("lng"), -20, 170, 20, -170)).select("c_custkey"))
query("geo_radius", f"SELECT c_custkey, round({_km(0.0, 179.0)}, 6) AS km FROM {_PL} WHERE {_km(0.0, 179.0)} <= 2000")(
    lambda spark, sf: search.within_radius(places(spark, sf), "lat", "lng", (0.0, 179.0), 2000).select("c_custkey", F.round("distance", 6).alias("km")))
_BITS = "list_aggregate(list_transform(range(30), lambda i: (CASE WHEN i % 2 = 0 THEN (x >> (14 - i // 2)::BIGINT) ELSE (y >> (14 - i // 2)::BIGINT) END & 1)::VARCHAR), 'string_agg', '')"
query("geohash6", f"SELECT c_custkey, array_to_string(list_transform(range(6), lambda k: substr('{geo.BASE32}', 1 + list_sum(list_transform(range(5), lambda b: (substr(bits, (k * 5 + b + 1)::BIGINT, 1) = '1')::INT * (16 >> b::INT)))::BIGINT, 1)), '') AS g FROM (SELECT c_custkey, {_BITS} AS bits FROM (SELECT c_custkey, least(32767, floor((lng + 180) / 360 * 32768))::BIGINT AS x, least(32767, floor((lat + 90) / 180 * 32768))::BIGINT AS y FROM {_PL}))")(
    lambda spark, sf: places(spark, sf).select("c_custkey", geo.geohash(F.col("lat"), F.col("lng"), 6).alias("g")))


_XY = f"(SELECT c_custkey, least(32767, floor((lng + 180) / 360 * 32768))::BIGINT AS x, least(32767, floor((lat + 90) / 180 * 32768))::BIGINT AS y FROM {_PL})"
_SPELT = f"array_to_string(list_transform(range(6), lambda k: substr('{geo.BASE32}', 1 + list_sum(list_transform(range(5), lambda b: (substr(bits, (k * 5 + b + 1)::BIGINT, 1) = '1')::INT * (16 >> b::INT)))::BIGINT, 1)), '')"
_AROUND = "(SELECT a AS dx, b AS dy FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b))"


@query("geohash_decode", f"SELECT c_custkey, round((y + 0.5) * 180 / 32768 - 90, 6) AS lat, round((x + 0.5) * 360 / 32768 - 180, 6) AS lng FROM {_XY}")
def geohash_decode(spark, sf):
    centre = dealt(places(spark, sf)).select("c_custkey", geo.decode(F.upper(geo.geohash(F.col("lat"), F.col("lng"), 6))).alias("at"))
    return centre.select("c_custkey", F.round("at.lat", 6).alias("lat"), F.round("at.lng", 6).alias("lng"))


def _around(wrap: bool):
    def f(spark, sf):
        near = geo.neighbours(geo.geohash(F.col("lat"), F.col("lng"), 6), wrap)
        return dealt(places(spark, sf)).select("c_custkey", F.explode(near).alias("g"))

    return f


query("geohash_neighbours_wrapped", f"SELECT c_custkey, {_SPELT} AS g FROM (SELECT c_custkey, {_BITS} AS bits FROM (SELECT c_custkey, (x + dx + 32768) % 32768 AS x, greatest(0, least(32767, y + dy)) AS y FROM {_XY}, {_AROUND} WHERE dx != 0 OR dy != 0))")(_around(True))
query("geohash_neighbours_on_map", f"SELECT c_custkey, {_SPELT} AS g FROM (SELECT c_custkey, {_BITS} AS bits FROM (SELECT c_custkey, x + dx AS x, y + dy AS y FROM {_XY}, {_AROUND}) WHERE x BETWEEN 0 AND 32767 AND y BETWEEN 0 AND 32767)")(_around(False))
query("geohash_covering", f"SELECT {_SPELT} AS geohash FROM (SELECT {_BITS} AS bits FROM (SELECT (32750 + a) % 32768 AS x, b AS y FROM (SELECT unnest(range(31)) AS a), (SELECT unnest(range(16384, 16389)) AS b)))")(
    lambda spark, sf: geo.covering(spark, 0.0, 32750 / 32768 * 360 - 180, 4.5 / 32768 * 180, 12.5 / 32768 * 360 - 180, 6))

# access
query("access_namespaces", "SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority, '1-') OR starts_with(o_orderpriority, '2-HIGH')")(
    lambda spark, sf: table(spark, sf, "orders").filter(access.in_namespaces(F.col("o_orderpriority"), ["1-", "2-HIGH"])).select("o_orderkey"))


@query("access_entities", "SELECT o_orderkey FROM orders WHERE o_custkey % 5 != 0 OR o_custkey % 10 = 0 OR o_custkey % 15 = 0")
def access_entities(spark, sf):
    c = F.col("c_custkey")
    name = lambda who, when: F.when(when, F.array(F.lit(who))).alias(who)
    acl = table(spark, sf, "customer").filter(c % 5 == 0).select(c.alias("o_custkey"), F.when(c % 30 == 0, "me").otherwise("other").alias("owner"), name("writers", F.lit(False)), F.when(c % 15 == 0, F.array(F.lit("me"))).alias("readers"), (c % 10 == 0).alias("public"))
    return access.visible(table(spark, sf, "orders"), acl, "o_custkey", "me").select("o_orderkey")


@query("typed_json_roundtrip", """SELECT c_custkey, '{"type":4,"value":' || c_nationkey || '.5}' AS number, '{"type":3,"value":"' || c_custkey || '"}' AS whole, '{"type":10,"value":{"@ref":"n:' || c_nationkey || '"}}' AS ref, 'n:' || c_nationkey AS read_ref, c_custkey AS read_whole FROM customer""")
def typed_json_roundtrip(spark, sf):
    def written(kind: int, **cells: Column) -> Column:
        have = {c: cells.get(c, F.lit(None)).cast(t) for c, t in triples._VALUES.items()}
        return F.struct(F.lit(kind).alias("obj_type"), *[v.alias(c) for c, v in have.items()])

    c = table(spark, sf, "customer")
    ref = F.concat(F.lit("n:"), F.col("c_nationkey"))
    for name, cell in (("number", written(triples.FLOAT64, obj_float64=F.col("c_nationkey") + 0.5)), ("whole", written(triples.INT64, obj_int64=F.col("c_custkey"))), ("ref", written(triples.REF, obj_ref=ref))):
        c = c.select("*", cell.alias("o")).select(*c.columns, "o.*").select(*c.columns, typed_json.to_json(wrap_refs=True).alias(name))
    return c.select("c_custkey", "number", "whole", "ref", typed_json.from_json(F.col("ref"))["obj_ref"].alias("read_ref"), typed_json.from_json(F.col("whole"))["obj_int64"].alias("read_whole"))


def _asked(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    e = table(spark, sf, "embeddings")
    return e, F.array(*[F.lit(float(x)) for x in e.filter("vec_id = 0").first()["embedding"]])


_V = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)"
for _name, _sql, _fn, _up in (("cosine", "list_cosine_similarity(v, q)", vectors.cosine_similarity, False), ("euclidean", "list_distance(v, q)", vectors.euclidean, True), ("inner", "1 - list_inner_product(v, q)", vectors.inner_product_distance, True)):
    def _knn(spark, sf, fn=_fn, up=_up):
        e, q = _asked(spark, sf)
        return search.nearest(e, "vec_id", fn(F.col("embedding"), q), 10, up).select("vec_id", (F.round("distance", 6) + 0.0).alias("d"))

    query(f"knn_{_name}", f"SELECT vec_id, round({_sql}, 6) + 0.0 AS d FROM {_V} ORDER BY {_sql} {'ASC' if _up else 'DESC'}, vec_id LIMIT 10")(_knn)


@query("binary_hamming", f"SELECT vec_id, list_sum(list_transform(list_zip(v, q), lambda p: ((p[1] > 0) != (p[2] > 0))::INT))::INT AS d FROM {_V}")
def binary_hamming(spark, sf):
    e, q = _asked(spark, sf)
    return e.select("vec_id", vectors.hamming(vectors.binary_words(F.col("embedding"), 64), vectors.binary_words(q, 64)).alias("d"))


query("int8_quantize", "SELECT vec_id, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: greatest(-127, least(127, floor((v + 1.0) / (2.0 / 254) - 127 + 0.5)))::INT))::BIGINT AS s FROM embeddings")(
    lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", F.aggregate(vectors.int8(F.col("embedding"), -1.0, 1.0), F.lit(0).cast("long"), lambda a, x: a + x).alias("s")))

# search
_T = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t != '')"
_TD = f"(SELECT doc_id, {_T} AS ts FROM documents)"


def _tf(t: str) -> str:
    return f"len(list_filter(ts, lambda x: x = '{t}'))"


_BM = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(2))
_INDEXES: dict[tuple[str, str], search.TextIndex] = {}


def text_index(spark: SparkSession, sf: str) -> search.TextIndex:
    """The written index of the documents: built once per session and table, read by every text query."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _INDEXES:
        docs = table(spark, sf, "documents").select("doc_id", "text")
        _INDEXES[at] = search.TextIndex.write(docs, "doc_id", "text", f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}", stem=True)
    return _INDEXES[at]


_BM25 = f"(WITH c AS (SELECT doc_id, len(ts) AS dl, {_tf('the')} AS tf0, {_tf('und')} AS tf1 FROM {_TD}), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, sum((tf0 > 0)::INT) AS df0, sum((tf1 > 0)::INT) AS df1 FROM c) SELECT doc_id, {_BM} AS score FROM c, s WHERE greatest(tf0, tf1) > 0)"
query("fts_bm25", f"SELECT doc_id, round(score, 6) AS score FROM {_BM25}")(
    lambda spark, sf: text_index(spark, sf).bm25(["the", "und"]).select("doc_id", F.round("score", 6).alias("score")))
query("fts_bm25_scan", f"SELECT doc_id, round(score, 6) AS score FROM {_BM25}")(
    lambda spark, sf: search.bm25(table(spark, sf, "documents"), "doc_id", "text", ["the", "und"]).select("doc_id", F.round("score", 6).alias("score")))
query("fts_bm25_page", f"SELECT doc_id, round(score, 6) AS score FROM {_BM25} ORDER BY round(score, 9) DESC, doc_id LIMIT 10 OFFSET 5")(
    lambda spark, sf: text_index(spark, sf).bm25(["the", "und"]).orderBy(F.round("score", 9).desc(), "doc_id").offset(5).limit(10).select("doc_id", F.round("score", 6).alias("score")))
query("fts_and", f"SELECT doc_id FROM {_TD} WHERE list_has_all(ts, ['the', 'with'])")(lambda spark, sf: text_index(spark, sf).all_of(["the", "with"]))
query("fts_or", f"SELECT doc_id FROM {_TD} WHERE list_has_any(ts, ['with', 'und'])")(lambda spark, sf: text_index(spark, sf).any_of(["with", "und"]))
query("fts_phrase", f"SELECT doc_id FROM {_TD} WHERE contains(' ' || array_to_string(ts, ' ') || ' ', ' of the ')")(lambda spark, sf: text_index(spark, sf).phrase(["of", "the"]))
query("fts_prefix", f"SELECT doc_id FROM {_TD} WHERE len(list_filter(ts, lambda t: starts_with(t, 'stup'))) > 0")(lambda spark, sf: text_index(spark, sf).prefix("stup"))
query("fts_not", f"SELECT doc_id FROM {_TD} WHERE NOT list_has_any(ts, ['the', 'der'])")(lambda spark, sf: search.match_none(table(spark, sf, "documents"), "text", ["the", "der"]).select("doc_id"))
query("fts_boolean", f"SELECT doc_id FROM {_TD} WHERE list_has_all(ts, ['the']) AND list_has_any(ts, ['with', 'und']) AND contains(' ' || array_to_string(ts, ' ') || ' ', ' of the ') AND NOT list_has_any(ts, ['der'])")(
    lambda spark, sf: text_index(spark, sf).boolean(must=["the"], should=["with", "und"], must_not=["der"], phrases=[["of", "the"]]))
_STEM = r"regexp_replace(regexp_replace(regexp_replace(t, '(\w{3})(?:sses|ies)$', '\1'), '(\w{3})(?:ingly|edly|ing|ed|es|s|ly)$', '\1'), '(\w{2})(?:(b)b|(d)d|(f)f|(g)g|(m)m|(n)n|(p)p|(r)r|(t)t)$', '\1\2\3\4\5\6\7\8\9')"
query("fts_stemmed", f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(ts) AS t FROM {_TD}) WHERE {_STEM} = 'document'")(lambda spark, sf: text_index(spark, sf).stemmed("documents"))

# fusion of what three searchers find over the same ids: text, vectors, places
_VEC = "(SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings)"
_TOP = {"fts": f"(SELECT id, round(score, 9) AS score FROM (SELECT doc_id AS id, score FROM {_BM25}) ORDER BY round(score, 9) DESC, id LIMIT 50)", "vector": f"(SELECT id, round(score, 9) AS score FROM {_VEC} ORDER BY round(score, 9) DESC, id LIMIT 50)"}


def searchers(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """(id, score) of the 50 best of a text query and of a vector query."""
    e, q = _asked(spark, sf)
    found = {"fts": text_index(spark, sf).bm25(["the", "und"]).select(F.col("doc_id").alias("id"), "score"), "vector": e.select(F.col("vec_id").alias("id"), vectors.cosine_similarity(F.col("embedding"), q).alias("score"))}
    return {name: s.select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(50) for name, s in found.items()}


query("hybrid_rrf", f"SELECT id, round(sum(1 / (60 + r)), 9) AS score FROM ({' UNION ALL '.join(f'SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM {t}' for t in _TOP.values())}) GROUP BY 1")(
    lambda spark, sf: search.fuse_rrf(searchers(spark, sf), "id").select("id", F.round("score", 9).alias("score")))
_NORMAL = {"fts": "score / (1 + score)", "vector": "greatest(0.0, least(1.0, score))"}
_PARTS = " UNION ALL ".join(f"SELECT id, {_NORMAL[n]} * {w} AS p, {w} AS w, '{n}' AS source FROM {_TOP[n]}" for n, w in (("fts", 1.0), ("vector", 2.0)))


def _weighted(present: bool):
    def f(spark, sf):
        found = {n: s.select("id", search.normalized(F.col("score"), n).alias("score")) for n, s in searchers(spark, sf).items()}
        return search.fuse_weighted({"fts": (found["fts"], 1.0), "vector": (found["vector"], 2.0)}, "id", present).select("id", F.round("score", 6).alias("score"), "primary_source")

    return f


query("hybrid_weighted", f"SELECT id, round(sum(p) / 3.0, 6) AS score, arg_max(source, p) AS primary_source FROM ({_PARTS}) GROUP BY 1")(_weighted(False))
query("hybrid_weighted_present", f"SELECT id, round(sum(p) / sum(w), 6) AS score, arg_max(source, p) AS primary_source FROM ({_PARTS}) GROUP BY 1")(_weighted(True))

# change log and windows


def change_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    op = F.when(F.col("event_id") % 11 == 0, "delete").otherwise("update")
    return e.select(F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("predicate"), op.alias("op"), "value", F.col("ts").alias("event_ts"), F.col("event_id").alias("sequence"))


_LOG = "SELECT user_id::VARCHAR AS subject, event_type AS predicate, value, event_id % 11 = 0 AS gone FROM events {} QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"
query("cdc_replay", f"SELECT subject, predicate, value FROM ({_LOG.format('')}) WHERE NOT gone")(lambda spark, sf: cdc.replay(change_log(spark, sf)).select("subject", "predicate", "value"))
query("restore_point_in_time", f"SELECT subject, predicate, value FROM ({_LOG.format(chr(10) + 'WHERE ts <= (SELECT min(ts) FROM events) + INTERVAL 5 DAY')}) WHERE NOT gone")(
    lambda spark, sf: cdc.replay((log := change_log(spark, sf)).join(F.broadcast(log.agg((F.min("event_ts") + F.expr("INTERVAL 5 DAYS")).alias("cap"))), F.col("event_ts") <= F.col("cap"))).select("subject", "predicate", "value"))
query("backup_list", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_events FROM events GROUP BY 1")(lambda spark, sf: cdc.backups(change_log(spark, sf)).select(F.col("day").cast("string").alias("day"), "n_events"))
query("compaction_plan", "SELECT o_orderkey AS chunk_id, floor(coalesce(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 10000)::BIGINT AS bin FROM orders")(
    lambda spark, sf: cdc.compaction_plan(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("namespace"), F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("size"), F.col("o_orderdate").alias("created")), 10000).select("chunk_id", "bin"))
query("window_tumbling", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(
    lambda spark, sf: windows.windowed(table(spark, sf, "events"), "ts", "1 hour", by=("event_type",)).withColumn("total", F.round("total", 4)))
query("window_sliding", "SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1")(
    lambda spark, sf: windows.windowed(table(spark, sf, "events"), "ts", "2 hours", "1 hour").withColumn("total", F.round("total", 4)))
query("session_gap", "SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL)::INT AS new FROM events)) GROUP BY user_id, s")(
    lambda spark, sf: windows.sessions(table(spark, sf, "events"), "ts", "user_id", "30 minutes"))
query("rate_limit_fixed_window", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms FROM events),
w AS (SELECT user_id, min(ms) AS s FROM e GROUP BY 1 UNION ALL SELECT w.user_id, min(e.ms) FROM w JOIN e ON e.user_id = w.user_id AND e.ms >= w.s + 3600000 GROUP BY w.user_id, w.s)
SELECT event_id, row_number() OVER (PARTITION BY user_id, s ORDER BY ms, event_id) <= 3 AS allowed FROM (SELECT e.*, w.s FROM e ASOF JOIN w ON e.user_id = w.user_id AND e.ms >= w.s)""")(
    lambda spark, sf: windows.fixed_window_limit(table(spark, sf, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))), "user_id", "ms", "event_id", 3, 3_600_000))
query("json_props", "SELECT event_id, json_valid(props) AS ok FROM events")(lambda spark, sf: table(spark, sf, "events").select("event_id", F.expr("try_parse_json(props) IS NOT NULL").alias("ok")))

from arbora import api_queries  # noqa: E402, F401 - registers more queries
