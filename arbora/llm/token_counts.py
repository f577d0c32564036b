"""Token counts as rollups that signed deltas maintain.

A batch of events (insert, delete, revise) becomes one small table of signed sums by
source, language and tokenizer version; totals are the sum over all committed batches.
A batch is committed by one atomic overwrite of its own folder, marked by Spark's
``_SUCCESS``: a batch that was committed before is not applied again, a half-written
one is written anew.  Sums are formed map-side, so a hot source shuffles one row a task.

Defined cases: null source, language or version are groups of their own; a null count
is 0; a revision adds the new count and takes the old one away, and leaves the number of
documents; events of other kinds are refused; a group whose documents and tokens are
both 0 is not listed; an empty batch commits and changes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.scratch import materialize, new_path
from arbora.llm.text import word_count

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class Rollup:
    """Totals kept under ``path``, a folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"a batch is named by letters, digits, _ and -, not {batch!r}")
        return f"{self.path}/batch={batch}"

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._fs_path(f"{self._folder(batch)}/_SUCCESS"))

    def batches(self) -> list[str]:
        if not self._fs.exists(self._fs_path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._fs_path(self.path))]
        return sorted(b for n in names if n.startswith("batch=") and self.committed(b := n[6:]))

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Apply events (op, source, lang, tokenizer, n_tokens and, to revise, old_tokens); whether it was news."""
        if self.committed(batch):
            return False
        deltas(events).write.mode("overwrite").parquet(self._folder(batch))
        return True

    def totals(self) -> DataFrame:
        folders = [self._folder(b) for b in self.batches()]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        summed = self.spark.read.schema(SCHEMA).parquet(*folders).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def deltas(events: DataFrame) -> DataFrame:
    """Signed sums of a batch of events."""
    new = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    old = F.coalesce(F.col("old_tokens"), F.lit(0)).cast("long") if "old_tokens" in events.columns else F.lit(0).cast("long")
    op = F.col("op")
    other = F.raise_error(F.concat(F.lit("unknown event "), F.coalesce(op, F.lit("null")))).cast("long")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(other).cast("long")
    tokens = F.when(op == "insert", new).when(op == "delete", -new).when(op == "revise", new - old).otherwise(other)
    return events.select(*KEYS, docs.alias("d"), tokens.alias("t")).groupBy(*KEYS).agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"))


def events(counted: DataFrame, op: str, tokenizer: str, n_tokens: Column, old_tokens: Column | None = None) -> DataFrame:
    old = F.lit(None).cast("long") if old_tokens is None else old_tokens
    return counted.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), n_tokens.alias("n_tokens"), old.alias("old_tokens"))


#: Pieces of the second version: runs of letters, of digits, of other visible characters.
PIECES = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]+"


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed over the whole table: loads under two versions, a takedown of what is labelled of
    quality 0, a revision that counts an end mark per document, and replays that change nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", "source", "lang", word_count(F.col("text")).alias("words"), F.regexp_count(text, F.lit(PIECES)).cast("long").alias("pieces"))
    counted = materialize(counted, "token-counts")
    bad = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").select("doc_id")
    gone, left = counted.join(bad, "doc_id", "left_semi"), counted.join(bad, "doc_id", "left_anti")
    words, pieces = F.col("words"), F.col("pieces")
    rollup = Rollup(spark, new_path(spark, "rollup"))
    load = events(counted, "insert", "words-v1", words).unionByName(events(counted, "insert", "pieces-v1", pieces))
    takedown = events(gone, "delete", "words-v1", words).unionByName(events(gone, "delete", "pieces-v1", pieces))
    for name, batch in (("load", load), ("takedown", takedown), ("load", load), ("revise", events(left, "revise", "words-v1", words + 1, words)), ("takedown", takedown)):
        rollup.commit(name, batch)
    return rollup.totals()


ORACLE = r"""
WITH d AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]+')) AS pieces
  FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND l.quality = 0)
)
SELECT source, lang, 'words-v1' AS tokenizer, count(*) AS n_docs, CAST(sum(words + 1) AS BIGINT) AS n_tokens FROM d GROUP BY ALL
UNION ALL
SELECT source, lang, 'pieces-v1', count(*), CAST(sum(pieces) AS BIGINT) FROM d GROUP BY ALL
"""
