"""Chat formatting of reply trees.

Messages (tree, id, parent) form trees.  Self-joins that double their reach give each
message its root distance and path score; leaves rank by score; the ancestors of each
chosen leaf, found by the same doubled links, become one formatted conversation.

Template: ``<s>``, then per turn ``[INST]text[/INST]`` for a user, ``text</s>`` for an
assistant, and a system block that names the role for any other.  A control string
inside a text gets a backslash after its first character, one that is so written
already gets one more; reading back takes one away.

Defined cases: null texts and roles are empty; a parent that is not in its tree makes a
root; of rows with one (tree, id) the least is kept; a path into a cycle has no root
and is left out; equal scores go to the smaller leaf id; no messages give no rows; a
null tree id is a tree; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.scratch import materialize

# The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
ESCAPE = rf"([<\[]\\*)({_TAILS})"
_UNESCAPE = re.compile(rf"([<\[]\\*)\\({_TAILS})")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ESCAPE, r"$1\\$2")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, depth, id) of the messages on the ``branches`` best paths of each tree.

    messages: tree, id, parent, score.  Every round is a written table, so lineage stays
    short; there are about log2(longest path) rounds each way.
    """
    known = messages.select("tree", F.col("id").alias("parent"))
    linked = messages.join(known.withColumn("there", F.lit(1)), ["tree", "parent"], "left")
    nodes = linked.select("tree", "id", F.when(F.col("there") == 1, F.col("parent")).alias("up"), F.lit(1).alias("depth"), F.coalesce("score", F.lit(0.0)).alias("score"))
    levels = [materialize(nodes, "reach")]
    most = levels[0].count().bit_length() + 1
    while len(levels) <= most and not levels[-1].filter("up IS NOT NULL").isEmpty():
        cur = levels[-1]
        above = cur.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("score").alias("s2"))
        joined = cur.join(above, ["tree", "up"], "left")
        far = joined.select("tree", "id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), (F.col("score") + F.coalesce("s2", F.lit(0.0))).alias("score"))
        levels.append(materialize(far, "reach"))
    done = levels[-1].filter("up IS NULL")
    leaves = done.join(levels[0].select("tree", F.col("up").alias("id")), ["tree", "id"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("id"))
    chosen = leaves.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= branches).select("tree", "branch", "id")
    path = materialize(chosen, "path")
    for level in reversed(levels[:-1]):
        links = level.filter("up IS NOT NULL").select("tree", "id", "up")
        path = materialize(path.unionByName(path.join(links, ["tree", "id"]).select("tree", "branch", F.col("up").alias("id"))), "path")
    return path.join(done.select("tree", "id", "depth"), ["tree", "id"])


def _turns(turns: Column) -> Column:
    """Formatted pieces: before, text, after, loss; joined they are the conversation."""

    def piece(t: Column) -> Column:
        role = F.coalesce(t["role"], F.lit(""))
        name = F.regexp_replace(F.regexp_replace(escape(role), r"\\", r"\\\\"), "\n", r"\\n")
        user, assistant = role == "user", role == "assistant"
        return F.struct(
            F.when(user, "[INST]").when(assistant, "").otherwise(F.concat(F.lit("<<SYS>>"), name, F.lit("\n"))).alias("before"),
            escape(t["text"]).alias("text"),
            F.when(user, "[/INST]").when(assistant, "</s>").otherwise("<</SYS>>").alias("after"),
            assistant.alias("loss"),
        )

    return F.transform(turns, piece)


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """One row per chosen path: tree, branch, n_turns, formatted, loss_spans.

    messages: tree, id, parent, role, text and, if branches differ in worth, score.
    loss_spans: [start, end) in code points of ``formatted`` for each assistant text.
    """
    score = F.col("score").cast("double") if "score" in messages.columns else F.lit(0.0)
    tree = F.coalesce(F.col("tree").cast("string"), F.lit("\x00"))
    rows = messages.select(F.col("tree").alias("tree_id"), tree.alias("tree"), "id", "parent", score.alias("score"), "role", "text")
    kept = F.min(F.struct("parent", "score", "role", "text", "tree_id")).alias("m")
    rows = materialize(rows.groupBy("tree", "id").agg(kept).select("tree", "id", "m.*"), "messages")
    path = best_paths(rows.select("tree", "id", "parent", "score"), branches)
    turns = path.join(rows.select("tree", "id", "tree_id", "role", "text"), ["tree", "id"])
    listed = turns.groupBy("tree", "branch").agg(F.first("tree_id").alias("tree_id"), F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    pieces = listed.select(F.col("tree_id").alias("tree"), "branch", _turns(F.col("turns")).alias("pieces"))
    pieces = pieces.withColumn("n_turns", F.size("pieces").cast("long"))
    joined = F.concat(F.lit("<s>"), F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), ""))
    zero = F.struct(F.lit(3).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["before"])
        end = start + F.length(p["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + F.length(p["after"])).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return pieces.select("tree", "branch", "n_turns", joined.alias("formatted"), F.aggregate("pieces", zero, step, lambda acc: acc["spans"]).alias("loss_spans"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], len("<s>")
    while at < len(formatted):
        if formatted.startswith("[INST]", at):
            begin, close, role = at + 6, "[/INST]", "user"
        elif formatted.startswith("<<SYS>>", at):
            line = formatted.index("\n", at)
            name = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], formatted[at + 7 : line])
            begin, close, role = line + 1, "<</SYS>>", unescape(name)
        else:
            begin, close, role = at, "</s>", "assistant"
        end = formatted.index(close, begin)
        out.append((role, unescape(formatted[begin:end])))
        at = end + len(close)
    return out


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, loss in zip(formatted, spans, strict=True):
        turns = parse(text)
        under = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
        whole = "".join(f"{role}\n{body}\n" for role, body in turns)
        rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: Column | str, spans: Column | str) -> Column:
    """Digest struct of a formatted conversation, from its parsed turns and the text under the loss spans."""
    return F.pandas_udf(_read_back, _DIGEST)(formatted, spans)


#: The conversation that the contract adds: control strings inside both texts.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def chains(table: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees without forks: each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table.withColumn("id", F.row_number().over(order))
    parent = F.when(F.col("id") > 1, F.col("id") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "id", parent.alias("parent"), "role", "text")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    out = conversations(chains(table.unionByName(extra)))
    return out.select(F.col("tree").alias("conv_id"), read_back("formatted", "loss_spans").alias("d")).select("conv_id", "d.*")


_C = r"(regexp_replace(coalesce({0}, ''), '([<\[]\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g'))"
ORACLE = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, CAST(length({_C.format('text')}) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 4
    ELSE 16 + length(replace(replace({_C.format('role')}, '\', '\\'), chr(10), '\n')) END AS BIGINT) AS n FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
