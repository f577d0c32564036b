"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from arbora.queries import QUERIES, text_index

HEADLINE = [
    "path_3hop_filter", "lookup_entity", "multi_hop_distinct", "recurse_cyclic_min_depth", "pos_range", "materialize_entity", "latest_version",
    "merge_union", "group_by_value_top20", "fts_bm25", "fts_phrase", "knn_cosine", "geo_radius", "hybrid_rrf", "cdc_replay", "window_tumbling", "session_gap",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    began = time.perf_counter()
    text_index(spark, sf_dir)  # written once and kept; the text queries read it
    setup = {"text_index_build": round(time.perf_counter() - began, 3)}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "setup": setup, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
