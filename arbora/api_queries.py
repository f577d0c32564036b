"""Queries over patterns, pages, the graph facade, URL rules, validation, hashes, logs and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions import urls, validation, vectors
from arbora.operators import combine, search, triples
from arbora.operators.graph import Graph, Step, match
from arbora.plans.catalog import BASE, iri, star_catalog
from arbora.plans.compiler import run
from arbora.queries import _AB, _N, _ORIGIN, _P, _S, _SEGS, _orders, change_log, customer_triples, order_versions, paths, query, table, text_index
from arbora.streaming import cdc, windows

# path language
paths("recurse_reverse", "turn:10002 <- next*[depth <= 2] { conv_id, turn }", "SELECT conv_id, turn FROM conversations WHERE conv_id = 1 AND turn < 2 AND EXISTS (SELECT 1 FROM conversations WHERE conv_id = 1 AND turn = 2)")


@query("lookup_string_id", "SELECT c_name FROM customer WHERE c_custkey = 7")
def lookup_string_id(spark, sf):
    c = star_catalog(spark, sf)
    return run(c, 'customer:"7" { c_name }').unionByName(run(c, 'customer:"abc-1" { c_name }'))


# patterns of hops
query("match_one_hop", "SELECT c_custkey AS key, c_name FROM customer WHERE c_nationkey = 3")(
    lambda spark, sf: match(star_catalog(spark, sf), "nation", F.col("key") == 3, [Step("inNation", reverse=True)], fields=["c_name"]))
query("match_two_hops_where", "SELECT o_orderkey AS key, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 AND o_totalprice > 150000 AND o_orderstatus = 'O'")(
    lambda spark, sf: match(star_catalog(spark, sf), "nation", F.col("key") == 3, [Step("inNation", reverse=True), Step("placedBy", reverse=True)], (F.col("o_totalprice") > 150000) & (F.col("o_orderstatus") == "O"), ["o_totalprice"]))
query("match_ids_in", "SELECT o_orderkey AS key FROM orders WHERE o_custkey IN (1, 2, 4, 9999999)")(
    lambda spark, sf: match(star_catalog(spark, sf), "customer", None, [Step("placedBy", reverse=True)], keys=[1, 2, 4, 9999999]))
query("match_variable_length", "SELECT DISTINCT conv_id * 10000 + turn AS key FROM conversations c WHERE turn IN (1, 2) AND EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = 0) AND (turn = 1 OR EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = 1))")(
    lambda spark, sf: match(star_catalog(spark, sf), "turn", F.col("turn") == 0, [Step("next", least=1, most=2)]))
query("match_limit", "SELECT o_orderkey AS key FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5) ORDER BY 1 LIMIT 25")(
    lambda spark, sf: match(star_catalog(spark, sf), "nation", F.col("key") == 5, [Step("inNation", reverse=True), Step("placedBy", reverse=True)], limit=25))


# scans a page at a time, batches, versions
def _logged(spark, sf):
    """Status versions of orders with the place of each in the log."""
    key = F.regexp_extract("subject", r"(\d+)$", 1).cast("long")
    return order_versions(spark, sf).withColumn("seq", key * 4 + F.col("timestamp"))


_VERSIONS = f"""(SELECT '{BASE}order/' || o_orderkey AS subject, o_orderstatus AS status, 1 AS v, o_orderkey * 4 + 1 AS seq FROM orders
UNION ALL SELECT '{BASE}order/' || o_orderkey, 'X', 2, o_orderkey * 4 + 2 FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT '{BASE}order/' || o_orderkey, NULL, 3, o_orderkey * 4 + 3 FROM orders WHERE o_orderkey % 7 = 0)"""
query("point_scan_tombstone", f"SELECT subject, v::BIGINT AS timestamp, status FROM {_VERSIONS} WHERE subject = '{BASE}order/21' QUALIFY row_number() OVER (ORDER BY v DESC) = 1")(
    lambda spark, sf: triples.current(order_versions(spark, sf), f"{BASE}order/21", "status").select("subject", "timestamp", F.col("obj_string").alias("status")))
query("spo_page", f"SELECT seq, status FROM {_VERSIONS} WHERE subject = '{BASE}order/42' AND seq > 169 ORDER BY seq LIMIT 1")(
    lambda spark, sf: triples.spo_page(_logged(spark, sf), f"{BASE}order/42", "status", 1, 169).select("seq", F.col("obj_string").alias("status")))
query("pos_page", f"SELECT seq, subject FROM {_VERSIONS} WHERE status = 'X' AND seq > 500 ORDER BY seq LIMIT 50")(
    lambda spark, sf: triples.pos_page(_logged(spark, sf), "status", "=", "X", 50, 500).select("seq", "subject"))
query("osp_page", f"SELECT {_S} AS subject, c_custkey AS seq FROM customer WHERE c_nationkey = 3 AND c_custkey > 20 ORDER BY c_custkey LIMIT 15")(
    lambda spark, sf: triples.osp_page(customer_triples(spark, sf).withColumn("seq", F.regexp_extract("subject", r"(\d+)$", 1).cast("long")), f"{BASE}nation/3", 15, 20).select("subject", "seq"))
query("osp_batch", f"SELECT '{BASE}nation/' || k AS obj_ref, (SELECT count(*) FROM customer WHERE c_nationkey = k) AS n FROM (SELECT unnest([1, 2, 3, 99]) AS k)")(
    lambda spark, sf: triples.osp_by_target(customer_triples(spark, sf), spark.sql(f"SELECT concat('{BASE}nation/', k) AS obj_ref FROM (SELECT explode(array(1, 2, 3, 99)) AS k)")).select("obj_ref", F.size("sources").cast("long").alias("n")))
query("subject_prefix", f"SELECT {_S} AS subject, c_name FROM customer WHERE starts_with({_S}, '{BASE}customer/12')")(
    lambda spark, sf: triples.prefixed(customer_triples(spark, sf), f"{BASE}customer/12").filter("predicate = 'name'").select("subject", F.col("obj_string").alias("c_name")))
query("live_pairs", f"SELECT '{BASE}order/' || o_orderkey AS subject FROM orders WHERE o_orderkey % 7 != 0")(lambda spark, sf: triples.exists(order_versions(spark, sf)).select("subject"))
query("predicate_stats", "SELECT count(*) AS count, 0.0::DOUBLE AS sum, 0.0::DOUBLE AS avg FROM customer WHERE c_name IS NOT NULL")(lambda spark, sf: triples.predicate_stats(customer_triples(spark, sf), "name"))
query("predicate_stats_number", "SELECT count(*) AS count, round(sum(c_acctbal), 2) AS sum, round(avg(c_acctbal), 4) AS avg FROM customer")(
    lambda spark, sf: triples.predicate_stats(customer_triples(spark, sf), "balance").select("count", F.round("sum", 2).alias("sum"), F.round("avg", 4).alias("avg")))
query("type_names", "SELECT 'FLOAT64' AS t, count(*) AS n FROM customer UNION ALL SELECT 'REF', count(*) FROM customer UNION ALL SELECT 'STRING', 2 * count(*) FROM customer")(
    lambda spark, sf: customer_triples(spark, sf).groupBy(triples.type_name(F.col("obj_type")).alias("t")).agg(F.count(F.lit(1)).alias("n")))
query("postings_in_chunks", f"SELECT {_N} AS obj_ref, count(*) AS n FROM customer GROUP BY 1")(
    lambda spark, sf: triples.postings(customer_triples(spark, sf), chunks=4).groupBy("obj_ref").agg(F.sum(F.size("subjects")).alias("n")))


# the graph facade
def _graph(spark, sf) -> Graph:
    return Graph(customer_triples(spark, sf))


@query("graph_changes", f"SELECT {_S} AS subject, CASE WHEN c_custkey = 5 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey != 6 UNION ALL SELECT '{BASE}customer/new', 'FRESH'")
def graph_changes(spark, sf):
    g = _graph(spark, sf).update(f"{BASE}customer/5", {"segment": "NEW"}).delete(f"{BASE}customer/6").create(f"{BASE}customer/new", {"$type": "Customer", "segment": "FRESH"})
    return g.live().filter("predicate = 'segment'").select("subject", F.col("obj_string").alias("segment"))


@query("graph_batch", f"SELECT {_S} AS subject, CASE WHEN c_custkey IN (10, 20, 30, 40, 50) THEN 'B' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey NOT IN (7, 8)")
def graph_batch(spark, sf):
    changes = [("update", f"{BASE}customer/{k}", {"segment": "B"}) for k in (10, 20, 30, 40, 50)] + [("delete", f"{BASE}customer/{k}", {}) for k in (7, 8)] + [("create", f"{BASE}customer/9", {"segment": "no"}), ("delete", f"{BASE}customer/none", {})]
    g = _graph(spark, sf).execute(changes)
    assert [i for i, _ in g.errors] == [7, 8]
    return g.live().filter("predicate = 'segment'").select("subject", F.col("obj_string").alias("segment"))


query("graph_get", f"SELECT k AS subject, CASE WHEN c_name IS NOT NULL THEN 'Thing' END AS type, c_name AS name, {_N} AS nation FROM (SELECT unnest(['{BASE}customer/3', '{BASE}customer/4', '{BASE}customer/none']) AS k) LEFT JOIN customer ON k = {_S}")(
    lambda spark, sf: _graph(spark, sf).get(*(f"{BASE}customer/{k}" for k in (3, 4, "none"))).select("subject", "type", F.col("props")["name"][0].alias("name"), F.col("props")["inNation"][0].alias("nation")))
query("graph_traverse", f"SELECT {_S} AS key FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING' ORDER BY 1 LIMIT 20")(
    lambda spark, sf: _graph(spark, sf).reverse_traverse(f"{BASE}nation/3", "inNation", {"segment": "BUILDING"}, 20))
query("graph_path", f"SELECT {_N} AS key FROM customer WHERE c_custkey = 3")(lambda spark, sf: _graph(spark, sf).path(f"{BASE}customer/3", ["inNation"]))

# aggregates and merges
query("agg_skips_text", "SELECT sum(c_custkey)::DOUBLE AS value FROM customer WHERE c_custkey % 2 = 0")(
    lambda spark, sf: combine.aggregate(table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("no number").alias("v")), "v", "sum"))
for _pre, _sql in ((False, f"SELECT count(*) AS value FROM orders WHERE {_AB[0]} OR {_AB[1]}"), (True, f"SELECT (SELECT count(*) FROM orders WHERE {_AB[0]}) + (SELECT count(*) FROM orders WHERE {_AB[1]}) AS value")):
    query(f"agg_{'before' if _pre else 'after'}_merge", _sql)(lambda spark, sf, pre=_pre: combine.aggregate_sets([_orders(spark, sf, w) for w in _AB], "o_orderkey", "o_totalprice", "count", pre))
query("union_all", f"SELECT o_orderkey, 0 AS set_no FROM orders WHERE {_AB[0]} UNION ALL SELECT o_orderkey, 1 FROM orders WHERE {_AB[1]}")(lambda spark, sf: combine.union_all([_orders(spark, sf, w) for w in _AB]).select("o_orderkey", "set_no"))
query("dedupe_oldest", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")(lambda spark, sf: combine.dedupe(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", newest=False))
query("level_stats", "SELECT l_linenumber AS level, count(*) AS n_chunks, sum(l_suppkey)::BIGINT AS n_rows, sum(l_partkey)::BIGINT AS size FROM lineitem GROUP BY 1")(
    lambda spark, sf: combine.level_stats(table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("level"), F.col("l_suppkey").alias("n_rows"), F.col("l_partkey").alias("size"))))
query("offset_cursor_page", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 40")(
    lambda spark, sf: combine.offset_page(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], combine.read_offset(combine.offset_cursor(40)), 10))
query("without_metadata", "SELECT c_custkey FROM customer")(lambda spark, sf: combine.without_metadata(table(spark, sf, "customer").select("c_custkey", F.lit("n").alias("_namespace"), F.lit(1).alias("_local_id"))))

# URLs: what the rules say of odd ones, written out
_ODD = {
    "https://u:p@Api.Example.com:8443/a/b,c/?q=1,2#h": ("com,example,api,:8443,/a,/b,c,?q=1,2,#h", "https://api.example.com:8443/a/", "HAS_USER_INFO", ".com/.example/.api/a/b,c/"),
    "http://example.com:80": ("com,example", "http://example.com/", None, ".com/.example/"),
    "https://example.com:443/x?": ("com,example,/x", "https://example.com/", None, ".com/.example/x"),
    "https://example.com:80/x//y": ("com,example,/x,/y", "https://example.com:80/x/", None, ".com/.example/x//y"),
    "no url, at all": ("_invalid,no url%2C at all", "no url, at all", "INVALID_URL", None),
    "ftp://files.example.com/a": ("com,example,files,/a", "ftp://files.example.com/", "INVALID_PROTOCOL", None),
    "mailto:a@b.c": ("_invalid,mailto:a@b.c", "mailto:a@b.c", "INVALID_PROTOCOL", None),
    "http://../x": (",,,/x", "http://../", "INVALID_HOSTNAME", ".//.//./x"),
    "http:///x": ("_invalid,http:///x", "http:///x", "INVALID_URL", None),
    "   ": ("_invalid,   ", "   ", "EMPTY", None),
    "https://e.x/a​b": ("x,e,/a​b", "https://e.x/", "INVALID_CHARACTERS", ".x/.e/a​b"),
}
_ODD_KEPT = {u: v for u, v in _ODD.items() if u != "http://../x"}


def _sql_text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


query("url_rules_odd", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql_text, (u, *v))) + ")" for u, v in _ODD_KEPT.items()) + ") t(url, k, ns, error, p)")(
    lambda spark, sf: spark.createDataFrame([(u,) for u in _ODD_KEPT], "url string").select("url", urls.sort_key(F.col("url")).alias("k"), urls.namespace(F.col("url")).alias("ns"), urls.entity_id_error(F.col("url")).alias("error"), urls.storage_path(F.col("url")).alias("p")))
_QF = r"CASE WHEN regexp_extract(url, '^[^?#]*(\?[^#]+)', 1) = '' THEN '' ELSE regexp_extract(url, '^[^?#]*(\?[^#]+)', 1) END || CASE WHEN regexp_extract(url, '(#.+)$', 1) = '' THEN '' ELSE regexp_extract(url, '(#.+)$', 1) END"
query("sort_key_to_url", f"SELECT page_id, regexp_replace({_ORIGIN}, '^[a-z]+', 'https') || CASE WHEN len({_SEGS}) = 0 THEN '/' ELSE array_to_string(list_transform({_SEGS}, lambda s: '/' || s), '') END || {_QF} AS u FROM pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", urls.key_to_url(urls.sort_key(F.col("url"))).alias("u")))
query("resolve_namespace", f"SELECT page_id, {_ORIGIN} AS namespace, {_ORIGIN} || CASE WHEN {_P} IN ('', '/') THEN '' WHEN ends_with({_P}, '/') THEN {_P}[:-2] WHEN len({_SEGS}) > 1 THEN '/' || array_to_string({_SEGS}[:-2], '/') ELSE '' END AS context, CASE WHEN ends_with({_P}, '/') OR {_P} = '' THEN '' ELSE {_SEGS}[-1] END AS local_id FROM pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", urls.resolve(F.col("url")).alias("r")).select("page_id", "r.*"))
query("entity_parts", f"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS protocol, array_to_string({_SEGS}, '|') AS path, coalesce({_SEGS}[-1], '') AS local_id FROM pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", urls.entity_parts(F.col("url")).alias("e")).select("page_id", "e.protocol", F.array_join("e.path", "|").alias("path"), "e.local_id"))
query("storage_path_to_url", f"SELECT page_id, regexp_replace(regexp_replace({_ORIGIN}, ':[0-9]+$', ''), '^[a-z]+', 'https') || CASE WHEN {_P} = '' THEN '/' ELSE {_P} END AS u FROM pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", urls.path_to_url(urls.storage_path(F.col("url"))).alias("u")))
query("host_and_domain", f"SELECT page_id, array_to_string(list_reverse(string_split(regexp_replace(substr({_ORIGIN}, position('://' IN {_ORIGIN}) + 3), ':[0-9]+$', ''), '.')), ',') AS host, array_to_string(list_reverse(string_split(regexp_replace(substr({_ORIGIN}, position('://' IN {_ORIGIN}) + 3), ':[0-9]+$', ''), '.'))[:2], ',') AS domain FROM pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", urls.key_host(urls.sort_key(F.col("url"))).alias("host"), urls.key_domain(urls.sort_key(F.col("url"))).alias("domain")))
query("sort_by_url_key", f"SELECT page_id FROM pages WHERE starts_with(array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#:]*)', 1), '.')), ','), 'com,')")(
    lambda spark, sf: table(spark, sf, "pages").withColumn("k", urls.sort_key(F.col("url"))).repartitionByRange("k").sortWithinPartitions("k").filter(F.startswith("k", F.lit("com,"))).select("page_id"))
query("log_paths", "SELECT event_id, '.com/.example/.tpch/events/_wal/' || strftime(ts, '%Y-%m-%d') || '/' || strftime(ts, '%H%M%S-%g') || '.gcol' AS p, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H%M%S-%g') AS sequence FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", urls.log_path(F.lit(BASE + "events"), F.unix_millis(F.col("ts").cast("timestamp"))).alias("p")).select("event_id", "p", urls.log_path_parts(F.col("p")).alias("x")).select("event_id", "p", "x.*"))
query("knowledge_ids", "SELECT * FROM (VALUES ('Q42', 'org,wikidata,entity,Q42', 'com,imdb,title,Q42'), ('P31', 'org,wikidata,prop,P31', NULL), ('L7', 'org,wikidata,lexeme,L7', NULL), ('X1', 'org,wikidata,X1', NULL)) t(name, k, e)")(
    lambda spark, sf: spark.createDataFrame([(x,) for x in ("Q42", "P31", "L7", "X1")], "name string").select("name", urls.knowledge_segments(F.col("name")).alias("k"), urls.external_segments(F.when(F.col("name") == "Q42", "P345").otherwise("P0"), F.col("name"), {"P345": "com,imdb,title"}).alias("e")))

# validation
_TX = "01ARZ3NDEKTSV4RRFFQ69G5FAV"
_BAD = [
    ("https://e.x/1", "name", 5, None, "v", None, 1, _TX, ""), (None, "name", 5, None, "v", None, 1, _TX, "subject is required"), ("x", "a:b", 5, None, None, None, -1, "short", "subject is no entity id|predicate has a colon|object does not fit its type|timestamp is negative|transaction is no ULID"),
    ("https://e.x/1", "1a", 2, None, None, 2**31, None, None, "predicate is no identifier|object does not fit its type|timestamp is required|transaction is required"), ("https://e.x/1", "p", 10, "mailto:x", None, None, 0, _TX, "object does not fit its type"), ("https://e.x/1", "p", 0, None, None, None, 0, _TX, ""),
    ("https://e.x/1", "p", 9, None, "P1DT2H", None, 0, _TX, ""), ("https://e.x/1", "p", 9, None, "1 day", None, 0, _TX, "object does not fit its type"),
]


@query("triple_errors", "SELECT * FROM (VALUES " + ", ".join(f"({k}, {_sql_text(r[-1])})" for k, r in enumerate(_BAD)) + ") t(id, errors)")
def triple_errors(spark, sf):
    schema = "id int, subject string, predicate string, obj_type int, obj_ref string, obj_string string, obj_int64 long, timestamp long, tx_id string"
    rows = spark.createDataFrame([(k, *r[:-1]) for k, r in enumerate(_BAD)], schema).withColumns({"obj_float64": F.lit(None).cast("double"), "obj_bool": F.lit(None).cast("boolean"), "obj_timestamp": F.lit(None).cast("long")})
    return rows.select("id", F.array_join(validation.triple_errors(), "|").alias("errors"))


query("entity_errors", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'type is required|' ELSE '' END || 'field schema:name has a colon' AS errors FROM customer")(
    lambda spark, sf: table(spark, sf, "customer").select("c_custkey", F.array_join(validation.entity_errors(iri("customer", F.col("c_custkey")), F.when(F.col("c_custkey") % 2 == 1, "Customer"), ["name", "schema:name"]), "|").alias("errors")))
query("field_names", "SELECT * FROM (VALUES ('name', true), ('$type', true), ('schema:name', false), ('a b', false), ('', false), ('1x', false)) t(f, ok)")(
    lambda spark, sf: spark.createDataFrame([(x,) for x in ("name", "$type", "schema:name", "a b", "", "1x")], "f string").select("f", validation.is_field_name(F.col("f")).alias("ok")))
query("ulids", "SELECT count(*) AS n, count(*) AS valid, count(*) AS sorted FROM orders")(
    lambda spark, sf: table(spark, sf, "orders").select(validation.ulid(F.col("o_orderkey") + 1_700_000_000_000, F.col("o_orderkey")).alias("u"), F.lpad(F.hex(F.col("o_orderkey") + 1_700_000_000_000), 16, "0").alias("h"))
    .agg(F.count_distinct("u").alias("n"), F.count_if(urls.is_transaction_id(F.col("u"))).alias("valid"), F.count_distinct(F.substring("u", 1, 10)).alias("sorted")))

# hashes, bytes, quantisation
query("fnv1a_utf16", "SELECT * FROM (VALUES ('', 2166136261, '811c9dc5', 197), ('a', 3826002220, 'e40c292c', 44), ('foobar', 3214735720, 'bf9cf968', 104)) t(s, h, x, shard)")(
    lambda spark, sf: spark.createDataFrame([("",), ("a",), ("foobar",)], "s string").select("s", vectors.fnv1a(F.col("s")).alias("h"), vectors.hash_hex(vectors.fnv1a(F.col("s"))).alias("x"), vectors.shard_of(F.col("s")).cast("int").alias("shard")))
_STEP = "(xor({h}, c) * 16777619) % 4294967296"
query("fnv1a_pair", f"SELECT c_custkey, list_reduce(cs, lambda h, c: {_STEP.format(h='h')})::BIGINT AS h1, list_reduce(cs, lambda h, c: xor({_STEP.format(h='h')}, ({_STEP.format(h='h')}) // 65536))::BIGINT AS h2 FROM (SELECT c_custkey, list_prepend(2166136261::HUGEINT, list_transform(string_split(c_mktsegment, ''), lambda c: ascii(c)::HUGEINT)) AS cs FROM customer)")(
    lambda spark, sf: table(spark, sf, "customer").select("c_custkey", vectors.fnv1a_pair(F.col("c_mktsegment")).alias("p")).select("c_custkey", "p.*"))
query("crc32", "SELECT * FROM (VALUES ('', 0), ('123456789', 3421780262)) t(s, c)")(lambda spark, sf: spark.createDataFrame([("",), ("123456789",)], "s string").select("s", F.crc32(F.col("s").cast("binary")).alias("c")))
query("base64_utf8", "SELECT c_custkey, to_base64(encode(c_name)) AS b, c_name AS back FROM customer")(
    lambda spark, sf: table(spark, sf, "customer").select("c_custkey", F.base64(F.encode("c_name", "UTF-8")).alias("b"), F.decode(F.unbase64(F.base64(F.encode("c_name", "UTF-8"))), "UTF-8").alias("back")))
query("value_range", "SELECT min(x) AS low, max(x) AS high FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)")(lambda spark, sf: vectors.value_range(table(spark, sf, "embeddings"), "embedding"))
query("int8_error", "SELECT vec_id, true AS close FROM embeddings")(
    lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", F.forall(F.zip_with("embedding", vectors.from_int8(vectors.int8(F.col("embedding"), -1.0, 1.0), -1.0, 1.0), lambda a, b: F.abs(a - b) <= 1.0 / 254 + 1e-9), lambda x: x).alias("close")))
query("binary_dequantize", "SELECT vec_id, list_sum(list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1.0 ELSE -1.0 END))::DOUBLE AS s FROM embeddings")(
    lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", F.aggregate(vectors.from_binary_words(vectors.binary_words(F.col("embedding"), 64), 64), F.lit(0.0), lambda a, x: a + x).alias("s")))
query("cosine_distance_zero", "SELECT vec_id, 2.0::DOUBLE AS d FROM embeddings")(lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", vectors.cosine_distance(F.col("embedding"), F.array(*[F.lit(0.0)] * 64)).alias("d")))
query("normalized_scores", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN c_acctbal / (1 + c_acctbal) ELSE 0 END, 9) AS fts, greatest(0.0, least(1.0, c_acctbal)) AS vector, round(CASE WHEN c_acctbal > 0 THEN exp(-c_acctbal) ELSE 1 END, 9) AS geo FROM customer")(
    lambda spark, sf: table(spark, sf, "customer").select("c_custkey", *[(F.round if n != "vector" else lambda c, _: c)(search.normalized(F.col("c_acctbal"), n), 9).alias(n) for n in ("fts", "vector", "geo")]))
query("durations", "SELECT * FROM (VALUES ('P1D', true), ('PT5M', true), ('P', false), ('P1DT', false), ('5', false)) t(d, ok)")(
    lambda spark, sf: spark.createDataFrame([(x,) for x in ("P1D", "PT5M", "P", "P1DT", "5")], "d string").select("d", urls.is_duration(F.col("d")).alias("ok")))

# search
query("explorer_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_brand), 'a') ORDER BY p_partkey LIMIT 50")(
    lambda spark, sf: search.contains_name(table(spark, sf, "part"), ["p_name", "p_brand"], "A", "p_partkey").select("p_partkey"))
query("fts_snippet", "SELECT doc_id, true AS marked FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t = 'the') AS ts FROM documents) WHERE len(ts) > 0")(
    lambda spark, sf: table(spark, sf, "documents").join(text_index(spark, sf).any_of(["the"]), "doc_id", "left_semi").select("doc_id", F.contains(search.snippet(F.col("text"), ["the"]), F.lit("<b>")).alias("marked")))


# log, restore, compaction, windows
def _dated(spark, sf):
    return change_log(spark, sf).withColumn("date", F.date_format("event_ts", "yyyy-MM-dd"))


query("log_date_window", "SELECT event_id AS sequence FROM events WHERE ts >= (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY FROM events) AND ts < (SELECT date_trunc('day', min(ts)) + INTERVAL 4 DAY FROM events)")(
    lambda spark, sf: cdc.log_between((log := _dated(spark, sf)), *log.agg(F.date_add(F.min("date").cast("date"), 1).cast("string"), F.date_add(F.min("date").cast("date"), 4).cast("string")).first()).select("sequence"))
query("restore_resumed", "SELECT event_id AS sequence FROM events WHERE event_id > 1000 AND event_id % 11 != 0")(lambda spark, sf: cdc.to_replay(change_log(spark, sf), after=1000, include_deletes=False).select("sequence"))
query("restore_dry_run", "SELECT CASE WHEN event_id % 11 = 0 THEN 'delete' ELSE 'update' END AS op, count(*) AS n_events, max(event_id) AS last_sequence FROM events GROUP BY 1")(
    lambda spark, sf: cdc.dry_run(change_log(spark, sf)).select("op", "n_events", "last_sequence"))
query("compaction_bins", """SELECT o_orderstatus AS namespace, bin, count(*) AS chunks, sum(o_custkey)::BIGINT AS size FROM (SELECT o_orderstatus, o_custkey, floor(coalesce(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20000)::BIGINT AS bin FROM orders) GROUP BY 1, 2 HAVING count(*) >= 2""")(
    lambda spark, sf: cdc.merge_bins(cdc.compaction_plan(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("namespace"), F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("size"), F.col("o_orderdate").alias("created")), 20000)))
query("hit_rates", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, round(avg((value > 50)::INT), 9) AS hit_rate FROM events GROUP BY 1")(
    lambda spark, sf: windows.hit_rates(table(spark, sf, "events"), "ts", F.col("value") > 50).withColumn("hit_rate", F.round("hit_rate", 9)))
