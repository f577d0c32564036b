"""Readers and writers of the graph's file formats."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators.triples import melt


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``; a local one only where that is unset and one machine does all."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="arbora-"))
    return _LOCAL[0]


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where their table has fewer parts than cores, for work that is heavy for its bytes."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True, null: str = r"\N") -> DataFrame:
    """Tab-separated rows, gzip or plain; short rows end in nulls, long ones are cut."""
    return spark.read.schema(schema).csv(path, sep="\t", header=header, nullValue=null, quote='"', escape='"', mode="PERMISSIVE")


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON value per line; lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line != ''")


def movie_titles(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("movie", "tvSeries")) -> DataFrame:
    schema = "tconst string, titleType string, primaryTitle string, originalTitle string, isAdult string, startYear int, endYear int, runtimeMinutes int, genres string"
    return read_tsv(spark, path, schema).filter(F.col("titleType").isin(*kinds))


def credits(principals: DataFrame, base: str) -> DataFrame:
    """Edges (src, predicate, dst) of people to titles."""
    predicate = F.when(F.col("category") == "director", "directedBy").when(F.col("category").isin("actor", "actress", "self"), "starring")
    return principals.select(F.concat(F.lit(f"{base}/title/"), "tconst").alias("src"), predicate.alias("predicate"), F.concat(F.lit(f"{base}/name/"), "nconst").alias("dst")).filter("predicate IS NOT NULL")


def host_graph(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) hosts of an edge list of vertex ids: two equi-joins; Spark picks how by size."""
    name = lambda c: F.array_join(F.reverse(F.split(c, r"\.")), ".")
    v = vertices.select("id", name(F.col("reversed_host")).alias("host"))
    one = edges.join(v.select(F.col("id").alias("from_id"), F.col("host").alias("src")), "from_id")
    return one.join(v.select(F.col("id").alias("to_id"), F.col("host").alias("dst")), "to_id").select("src", "dst")


def records_to_triples(table: DataFrame, subject: Column, fields: dict[str, str], refs: dict[str, Column] | None = None) -> DataFrame:
    """Melt of any table; columns that are not named are skipped."""
    return melt(table, subject, fields, refs)


def write_lake(triples: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet sorted by subject, with Bloom filters on it: point reads skip row groups."""
    by = [F.col("subject")]
    ranged = triples.repartitionByRange(partitions, *by) if partitions else triples.repartitionByRange(*by)
    ranged.sortWithinPartitions("subject", "predicate").write.mode("overwrite").option("compression", "zstd").option("parquet.bloom.filter.enabled#subject", "true").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_triples, first, last, size) of a lake's files."""
    rows = spark.read.parquet(path).withColumns({"file": F.col("_metadata.file_path"), "size": F.col("_metadata.file_size")})
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_triples"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.first("size").alias("size"))


def synthetic_rows(spark: SparkSession, n: int) -> DataFrame:
    """Deterministic rows (id, name, category, value, score, active)."""
    r = spark.range(n)
    h = F.xxhash64("id")
    return r.select("id", F.concat(F.lit("item-"), F.col("id").cast("string")).alias("name"), F.substring(F.lit("ABCDE"), (F.col("id") % 5 + 1).cast("int"), F.lit(1)).alias("category"), F.pmod(h, F.lit(1000)).alias("value"), (F.pmod(h, F.lit(10007)) / 10007.0).alias("score"), (F.col("id") % 2 == 0).alias("active"))
