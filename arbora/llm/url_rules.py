"""URL filter: hand-written rules first, then association rules mined by FP-growth.

Labels are the verdicts of the hand-written rules on the URLs they fit, as the tables hold no
other labels of URLs.  FP-growth mines which tokens of a URL go with the block label; rules pruned
by support, confidence and redundancy are matched by an inverted index from token to rules.  A
URL that no hand-written rule fits is blocked if a mined rule fires, else allowed.

Before mining, rare tokens go and tokens that are met in exactly the same labelled rows are merged
into one item: each of them implies the others, so rules over any of them have the same support
and confidence, and many URLs of one long path don't multiply itemsets.  A rule over an item fires
by any token merged into it.

Defined cases: a null URL, or one without ``://``, has an empty host and path; repeated
rows are judged alike and counted as often in mining; without a block label nothing is
mined; an empty table gives an empty result; URLs of any length are taken whole; other columns
pass through ``judge`` (its own replace columns of their names; ``ur_`` names are its own).
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.scratch import materialize

MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.9
BLOCK = "label=block"
#: Verdict, host, path of each hand-written rule.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, path words, query keys; numbers count by their first digit and length."""
    named = lambda parts, prefix, body=lambda x: x: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), body(x)))
    number = lambda x: F.when(x.rlike(r"^[0-9]+$"), F.concat(F.substring(x, 1, 1), F.repeat(F.lit("#"), F.length(x) - 1))).otherwise(x)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(named(F.split(host, r"\."), "h:"), named(F.split(path, r"[^0-9A-Za-z\x{80}-\x{10ffff}]+"), "p:", number), keys))


def by_hand(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host the URL's is or lies under and whose path its path begins with."""
    found = [(verdict, h + p, ((host == h) | host.endswith("." + h)) & path.startswith(p)) for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    first = lambda pick: F.coalesce(*[F.when(fits, F.lit(pick(verdict, rule))) for verdict, rule, fits in found], F.lit(None).cast("string"))
    return first(lambda verdict, rule: rule), first(lambda verdict, rule: verdict)


def merged(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> tuple[DataFrame, dict[str, str]]:
    """``labelled`` with one item for tokens of the same rows and none for rare ones; and the item of each token.

    The driver receives the frequent tokens: (tokens of a URL) / support at most.
    """
    rows = materialize(labelled.select(F.monotonically_increasing_id().alias("row"), "items"), "labelled")
    told = rows.select("row", F.explode("items").alias("token"))
    counts = told.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(row))").alias("mark"))
    least = min_support * rows.count()
    frequent = counts.filter((F.col("n") >= least) | (F.col("token") == BLOCK)).collect()
    by_rows: dict[tuple[int, int], list[str]] = defaultdict(list)
    for r in frequent:
        by_rows[(0, 0) if r["token"] == BLOCK else (r["n"], r["mark"])].append(r["token"])
    alias = {t: min(held) for held in by_rows.values() for t in held}
    named = labelled.sparkSession.createDataFrame(sorted(alias.items()), "token string, item string")
    kept = told.join(F.broadcast(named), "token").groupBy("row").agg(F.collect_set("item").alias("items"))  # named is bounded by the support
    return kept.select("items"), alias


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[tuple[tuple[str, ...], float]]:
    """(tokens, confidence) of the rules for the block label; labelled: items array with the label among them.

    Support, confidence and redundancy bound the rules, not their length: itemsets above
    the support are at most (subsets of a URL's tokens) / support, whatever the size of the table.
    """
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(labelled)
    rules = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK))
    found = sorted(((tuple(sorted(r["antecedent"])), r["confidence"]) for r in rules.collect()), key=lambda r: (len(r[0]), r[0]))
    kept: list[tuple[tuple[str, ...], float]] = []
    by_first: dict[str, list[tuple[set[str], float]]] = defaultdict(list)
    for items, confidence in found:
        own = set(items)
        if not any(k < own and c >= confidence for t in items for k, c in by_first[t]):
            kept.append((items, confidence))
            by_first[items[0]].append((own, confidence))
    return kept


class RuleIndex:
    """Inverted index: item to the rules that hold it; a rule fires when all its items are met."""

    def __init__(self, rules: list[tuple[tuple[str, ...], float]], alias: dict[str, str] | None = None):
        self.alias = alias or {}
        self.size = [len(items) for items, _ in rules]
        self.postings: dict[str, list[int]] = defaultdict(list)
        for k, (items, _) in enumerate(rules):
            for t in items:
                self.postings[t].append(k)

    def fires(self, items: list[str]) -> bool:
        met: Counter[int] = Counter()
        for t in {self.alias.get(t, t) for t in items}:
            met.update(self.postings.get(t, ()))
        return any(n == self.size[k] for k, n in met.items())


def learn(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, url: str = "url") -> RuleIndex:
    """What can be mined from the URLs that the hand-written rules decide."""
    parts = pages.select(F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    sure = parts.select(by_hand(F.col("host"), F.col("path"), rules)[1].alias("verdict"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("items")).filter("verdict IS NOT NULL")
    labelled, alias = merged(sure.select(F.when(F.col("verdict") == "block", F.array_append("items", BLOCK)).otherwise(F.col("items")).alias("items")))
    return RuleIndex(mine(materialize(labelled, "labelled")) if BLOCK in alias else [], alias)


def mined_verdict(index: RuleIndex, items: Column) -> Column:
    """block if a mined rule fires, else allow."""

    @F.pandas_udf("boolean")
    def fires(urls: pd.Series) -> pd.Series:
        return urls.map(index.fires)

    return F.when(fires(items), "block").otherwise("allow")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict."""
    index = learn(pages, rules, url)
    own = pages.withColumn("ur_items", tokens(F.col(url), host_of(F.col(url)), path_of(F.col(url))))
    own = own.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, verdict = by_hand(F.col("host"), F.col("path"), rules)
    return own.withColumns({"rule": rule, "verdict": F.coalesce(verdict, mined_verdict(index, F.col("ur_items")))}).drop("ur_items")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
