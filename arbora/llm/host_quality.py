"""Quality rules with host verdicts, in DataFrame functions only.

Each text is measured by itself; failures are summed by host (``source``); a beta
prior fitted to all hosts shrinks each host's failure rate; documents of hosts whose
shrunk rate is too high are dropped with those that fail by themselves.

Defined cases: a null text has no words (so it fails); a null source is one host;
repeated rows count as often as they stand; an empty table gives an empty result;
extra columns pass through ``filter_documents`` whatever their names; ``verdicts`` adds hq,
hq_failed and hq_kept to the columns it is told to keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.scratch import materialize
from arbora.llm.text import bind, window_hashes, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host is dropped if its shrunk failure rate exceeds this.
MAX_HOST_RATE = 0.5


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; hashes: by window start."""

    def from_sorted(s: Column) -> Column:
        def twin(e: Column, i: Column) -> Column:
            near = lambda j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            return near(i - 1) | near(i + 1)

        starts = F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"]))
        step = lambda acc, p: F.struct(
            (acc["total"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("total"),
            (p + WINDOW).alias("end"),
        )
        zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, step, lambda acc: acc["total"])

    keyed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return bind(F.sort_array(keyed), from_sorted)


def repeated_words(w: Column) -> Column:
    """Words in ``WINDOW``-word windows that occur at least twice in the text."""
    hashes = window_hashes(w, (1, 2, 4))
    some = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h)))
    return F.when(F.size(w) <= WINDOW, 0).otherwise(some)


def _fails(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat * 100 > n_words * MAX_REPEAT_PERCENT)


def base_failed(text: Column) -> Column:
    """Whether a text fails by itself; one expression, so a filter evaluates it once."""
    return bind(words(text), lambda w: _fails(F.size(w).cast("long"), repeated_words(w).cast("long")))


def measures(text: Column) -> Column:
    """Struct of the text's own measures."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))
    dup_lines = bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return bind(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def host_failures(rows: DataFrame, host: str, failed: Column) -> DataFrame:
    """Rows and failures by host: summed map-side, so a task sends one row per host."""
    return rows.select(F.col(host).alias("hq_host"), failed.cast("long").alias("hq_failed")).groupBy("hq_host").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hq_failed").alias("failed")
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and strength of a beta prior by moments over all hosts; one row reaches the driver."""
    rate = F.col("failed") / F.col("n")
    row = hosts.agg(
        F.sum("n").alias("n"), F.sum("failed").alias("f"), F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("n") * rate * rate).alias("second"),
    ).first()
    if not row["n"]:
        return 0.0, 1.0
    mean = row["f"] / row["n"]
    sampling = mean * (1 - mean)
    if sampling <= 0:
        return mean, 1.0
    between = row["second"] / row["n"] - mean * mean - sampling * row["hosts"] / row["n"]
    rho = between / sampling
    return mean, min(1000.0, max(1.0, 1 / rho - 1)) if rho > 0 else 1000.0


def bad_hosts(hosts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    mean, strength = beta_prior(hosts)
    shrunk = (F.col("failed") + mean * strength) / (F.col("n") + strength)
    return hosts.filter(shrunk > max_rate).select("hq_host", F.lit(True).alias("hq_bad"))


def verdicts(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The columns ``keep`` with the measures ``hq``, ``hq_failed`` and ``hq_kept``.

    Texts are read and measured once; the measures, without the texts, are written
    before hosts are summed and joined back.
    """
    rows = docs.select(*keep, F.col(host).alias("hq_source"), measures(F.col(text)).alias("hq"))
    rows = materialize(rows, "measures")
    failed = _fails(F.col("hq.n_words"), F.col("hq.n_repeat_words"))
    bad = bad_hosts(materialize(host_failures(rows, "hq_source", failed), "hosts"), max_rate)
    joined = rows.join(bad, F.col("hq_source").eqNullSafe(F.col("hq_host")), "left")
    return joined.select(*keep, "hq", failed.alias("hq_failed"), (~failed & F.col("hq_bad").isNull()).alias("hq_kept"))


def filter_documents(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass, with the columns they came with; texts are read twice, never stored."""
    failed = base_failed(F.col(text))
    hosts = materialize(host_failures(docs, host, failed), "hosts")
    good = docs.filter(~failed)
    bad = bad_hosts(hosts, max_rate)
    return good.join(bad, good[host].eqNullSafe(bad["hq_host"]), "left_anti")


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = verdicts(docs, ["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[F.col(f"hq.{n}").alias(n) for n in names], F.col("hq_failed").alias("base_failed"), F.col("hq_kept").alias("kept"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT r, i, array_to_string(ws[i:i+7], ' ') AS s
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), dup AS (
  SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) >= 2
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 8)) AS k) GROUP BY r
), m AS (
  SELECT w.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.r = rep.r
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, CAST(sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS DOUBLE) AS f FROM b GROUP BY source
), p AS (
  SELECT mean, CASE WHEN mean * (1 - mean) <= 0 THEN 1.0 WHEN rho > 0 THEN least(1000.0, greatest(1.0, 1 / rho - 1)) ELSE 1000.0 END AS k
  FROM (SELECT mean, (second / n - mean * mean - mean * (1 - mean) * hosts / n) / nullif(mean * (1 - mean), 0) AS rho
        FROM (SELECT sum(f) / sum(n) AS mean, sum(f * f / n) AS second, CAST(sum(n) AS DOUBLE) AS n, count(*) AS hosts FROM h))
), bad AS (
  SELECT source FROM h, p WHERE (f + mean * k) / (n + k) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM b.source) AS kept
FROM b
"""
