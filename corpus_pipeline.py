"""The corpus pipeline: toxicity, quality, near-duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as
the next one's docs.  A stage's own intermediate tables go when the next stage begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import byte_bpe, host_quality, mixing, prob_minhash, scratch, toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the model learns from this table's labels."""
    scratch.begin(spark, "pipeline")
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.filter_documents(docs, model)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass by themselves and by their host."""
    scratch.begin(spark, "pipeline")
    return host_quality.filter_documents(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    scratch.begin(spark, "pipeline")
    return prob_minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    scratch.begin(spark, "pipeline")
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digest of the bytes that they decode to."""
    import public_tokenizers

    scratch.begin(spark, "pipeline")
    rank_file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = byte_bpe.round_trip(docs, rank_file, pattern, keep=["doc_id", "lang", "source"])
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", remove_toxic),
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", remove_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The stages learn a model and draw random numbers, which SQL can't repeat.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        scratch.end()
        docs = scratch.materialize(out, name)
    out = STAGES[-1][1](spark, docs, sf_dir)
    scratch.end()
    return out
