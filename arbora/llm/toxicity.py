"""Toxicity by noisy-channel deobfuscation and a learned lexicon.

Training rows give (a) a character trigram model of the corpus and (b) words and word
beginnings that mark toxic documents, with log-likelihood ratios.  A token that looks
disguised (leetspeak, letters spaced out or repeated) becomes a lattice: each observed
character may stand for itself, for a letter that it resembles, or for nothing; the
Viterbi path under the character model is the restored text, and that is scored.

Plain tokens are their own restoration.  Training counts every labelled row; exact copies, and near
copies by the registers of ``prob_minhash``, weigh one together.  A feature is kept by its rates among
toxic and clean rows, so that the balance of the labels does not matter.  Signatures meet the labels
first; only the texts of labelled rows are shuffled then, once, to meet their labels and weights.

Defined cases: null and empty texts score as texts without evidence; a label that is repeated counts once; documents without
a label, or with a null one, are not trained on; without toxic labels every score is
low; repeated rows score alike; extra columns pass through ``score``, whose own column
name is a parameter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import prob_minhash
from arbora.llm.scratch import materialize, settings

THRESHOLD = 0.7
#: Bands of 20 that near copies share: texts of Jaccard 0.8 do with probability 0.98, those of 0.5 with 0.03.
SHARED = 4
#: A feature needs so many toxic training documents.
MIN_DOCS = 5
#: Likelihood-ratio statistic (chi-squared, one degree) of equal rates that a feature has to exceed: five standard errors.
SURPRISE = 25.0
#: Weaker features are left out: common words that lean one way by chance.
MIN_RATIO = 3.0
PREFIXES = (4, 5, 6)
#: Entries of a task's counters and memo before they are emptied; bounds memory, not results.
HELD = 200_000
#: Characters between two states of the lattice that are held; what lies between is worked out again on the way back.
STRIDE = 512
#: Choices of a character up to which states are followed one by one.
NARROW = 4

# Letters that digits and symbols resemble.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz"}
SEPARATORS = " ._-*~\t​‌­"

_WORD = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
# What a gate lets into the lattice: any character that a letter can hide behind, or that can part letters.
_SIGNS = re.escape("".join(c for c in LEET if not c.isalnum() and c not in SEPARATORS))
_PARTS = re.escape(SEPARATORS)
_SPACED = re.compile(rf"(?:(?<![^\W_])[^\W_](?![^\W_])|[{_SIGNS}{_PARTS}]){{4,}}+")
_AROUND = "".join(c for c in SEPARATORS if c not in LEET)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_GAP = re.compile(rf"[{_PARTS}]{{3,}}")
_HIDDEN = re.compile(rf"[{re.escape(''.join(LEET))}{_PARTS}]")
_BASE = 28  # a to z, edge, other
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CODES = {c: k for k, c in enumerate(_LETTERS)} | {" ": 26}


def is_trained_on(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def _spaced_out(run: str) -> bool:
    """Whether a run has four characters that can be letters, one of them no wildcard."""
    letters = [c for c in run if c.isalnum() or c in LEET]
    return len(letters) > 3 and any(len(LEET.get(c, c)) < 3 for c in letters)


def features(words_in: set[str]) -> set[str]:
    out = set(words_in)
    for w in words_in:
        out.update("^" + w[:k] for k in PREFIXES if len(w) > k)
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of a task: features by label, character trigrams, and documents by label."""
    held: tuple[dict[str, float], dict[str, float]] = ({}, {})
    totals = [0.0, 0.0]
    table = np.full(128, 27, np.int64)
    for c, k in _CODES.items():
        table[ord(c)] = k
    trigrams = np.zeros(_BASE**3)

    def rows() -> pd.DataFrame:
        names = [*held[0].keys() | held[1].keys()]
        out = pd.DataFrame({"kind": ["f"] * len(names), "name": names, "n0": [held[0].get(x, 0.0) for x in names], "n1": [held[1].get(x, 0.0) for x in names]})
        held[0].clear()
        held[1].clear()
        return out

    for batch in batches:
        for text, toxic, weight in zip(batch["text"], batch["toxic"], batch["weight"], strict=True):
            lower = text.lower()
            totals[toxic] += weight
            mine = held[toxic]
            for x in features(set(_WORD.findall(lower))):
                mine[x] = mine.get(x, 0.0) + weight
            letters = np.frombuffer(" ".join(lower.split()).encode("ascii", "replace"), np.uint8)
            codes = np.concatenate(([26, 26], table[np.minimum(letters, 127)], [26]))
            trigrams += weight * np.bincount(codes[:-2] * _BASE * _BASE + codes[1:-1] * _BASE + codes[2:], minlength=_BASE**3)
            if len(held[0]) + len(held[1]) > HELD:
                yield rows()
    if not any(totals):
        return
    if held[0] or held[1]:
        yield rows()
    seen = np.flatnonzero(trigrams)
    yield pd.DataFrame({"kind": ["c"] * len(seen), "name": [str(k) for k in seen], "n0": trigrams[seen], "n1": np.zeros(len(seen))})
    yield pd.DataFrame({"kind": ["t"], "name": [""], "n0": [totals[0]], "n1": [totals[1]]})


@dataclass
class Step:
    """What a character may stand for: codes, their letters, log probabilities by the two letters before, the cost of nothing."""

    at: np.ndarray
    letters: dict[int, str]
    gain: np.ndarray
    skip: float | None
    choices: list[tuple[int, str, float]]


def _forward(p: np.ndarray, steps: list[Step]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Best log probabilities by state after the steps; for each step and state the letter before the last two, -1 where nothing was added."""
    backs = []
    for step in steps:
        new, back = np.full((_BASE, _BASE), -np.inf), np.full((_BASE, _BASE), -1, np.int8)
        live = np.flatnonzero(p.max(1) > -np.inf)
        sums = p[live, :, None] + step.gain[live]
        new[:, step.at], back[:, step.at] = sums.max(0), live[sums.argmax(0)]
        if step.skip is not None:
            stay = p + step.skip
            better = stay > new
            new[better], back[better] = stay[better], -1
        p = new
        backs.append(back)
    return p, backs


@dataclass
class Model:
    """What scoring needs: log probabilities of trigrams, evidence by feature, the log odds without any."""

    trigram: np.ndarray
    evidence: dict[str, float]
    base: float

    def __post_init__(self) -> None:
        self.memo: dict[str, float] = {}
        self.rows: list[list[float]] = self.trigram.reshape(-1, _BASE).tolist()
        self.steps: dict[tuple[str, int], Step] = {}
        self.paths: dict[tuple, tuple[str, tuple[int, int]]] = {}
        self.stretches: dict[str, float] = {}
        self.strong: dict[str, list[str]] = {}
        for f in self.evidence:
            if f[0] != "^" and len(f) >= 5:
                self.strong.setdefault(f[:5], []).append(f)

    def options(self, c: str, run: int) -> Step:
        """What the ``run``-th equal character in a row may stand for."""
        known = self.steps.get((c, min(run, 3)))
        if known is None:
            letters = {_CODES.get(c, 27): (c, 0.0 if c in _CODES else -1.0 if c.isalpha() else -6.0)}
            letters |= {_CODES[x]: (x, -1.5 if len(LEET[c]) < 3 else -2.0) for x in LEET.get(c, "")}
            skip = -0.1 if c in SEPARATORS else None if run < 2 else -4.0 if run == 2 else -0.3
            at = np.array([*letters])
            gain = self.trigram[:, :, at] + np.array([q for _, q in letters.values()])
            known = Step(at, {k: x for k, (x, _) in letters.items()}, gain, skip, [(k, x, q) for k, (x, q) in letters.items()])
            if len(self.steps) >= HELD // 100:
                self.steps.clear()
            self.steps[c, min(run, 3)] = known
        return known

    def decode(self, token: str) -> str:
        """The likeliest text behind a disguised token: the Viterbi path over all states.

        A state is the last two letters.  After two characters that can only be themselves one
        state is left, so that what comes before is settled and the lattice begins anew.
        """
        out: list[str] = []
        held: list[Step] = []
        state, run, sure, last, begin = (26, 26), 0, 0, "", (0, 0)
        for at, c in enumerate(token):
            run, last = run + 1 if c == last else 1, c
            step = self.options(c, run)
            plain = len(step.at) == 1 and step.skip is None
            sure = sure + 1 if plain else 0
            if plain and not held:
                out.append(c)
                state = (state[1], int(step.at[0]))
                continue
            begin = begin if held else (at, min(run, 3))
            held.append(step)
            if sure == 2:
                text, state = self._known(token[begin[0] : at + 1], begin[1], held, state, False)
                out.append(text)
                held = []
        if held:
            out.append(self._known(token[begin[0] :], begin[1], held, state, True)[0])
        return "".join(out)

    def _known(self, piece: str, run: int, steps: list[Step], state: tuple[int, int], ends: bool) -> tuple[str, tuple[int, int]]:
        """``_path``, which the piece, its first character's place in a run, the state and the end settle; short ones are held."""
        if len(piece) > 16:
            return self._path(steps, state, ends)
        key = (piece, run, state, ends)
        if key not in self.paths:
            if len(self.paths) >= HELD // 4:
                self.paths.clear()
            self.paths[key] = self._path(steps, state, ends)
        return self.paths[key]

    def _path(self, steps: list[Step], state: tuple[int, int], ends: bool) -> tuple[str, tuple[int, int]]:
        """The best path from a state, and the state that it comes to."""
        wide = any(len(step.at) > NARROW for step in steps)
        return (self._wide if wide else self._narrow)(steps, state, ends)

    def _narrow(self, steps: list[Step], state: tuple[int, int], ends: bool) -> tuple[str, tuple[int, int]]:
        """The path over the few states that few choices lead to; each carries its letters as a chain."""
        best: dict[int, tuple[float, tuple | None]] = {state[0] * _BASE + state[1]: (0.0, None)}
        for step in steps:
            new: dict[int, tuple[float, tuple | None]] = {}
            for ab, (p, chain) in best.items():
                row, shifted = self.rows[ab], ab % _BASE * _BASE
                for x, letter, cost in step.choices:
                    q = p + row[x] + cost
                    if shifted + x not in new or q > new[shifted + x][0]:
                        new[shifted + x] = q, (chain, letter)
            if step.skip is not None:
                for ab, (p, chain) in best.items():
                    if ab not in new or p + step.skip > new[ab][0]:
                        new[ab] = p + step.skip, chain
            best = new
        end = max(best, key=lambda ab: best[ab][0] + (self.rows[ab][26] if ends else 0.0))
        out, chain = [], best[end][1]
        while chain is not None:
            chain, letter = chain
            out.append(letter)
        return "".join(reversed(out)), divmod(end, _BASE)

    def _wide(self, steps: list[Step], state: tuple[int, int], ends: bool) -> tuple[str, tuple[int, int]]:
        """The path over all states at once, in arrays."""
        p = np.full((_BASE, _BASE), -np.inf)
        p[state] = 0.0
        begins, back = [], []
        for at in range(0, len(steps), STRIDE):
            begins.append(p)
            p, back = _forward(p, steps[at : at + STRIDE])
        a, b = end = divmod(int((p + self.trigram[:, :, 26] if ends else p).argmax()), _BASE)
        out = []
        for n in reversed(range(len(begins))):
            some = steps[n * STRIDE : (n + 1) * STRIDE]
            if n < len(begins) - 1:
                back = _forward(begins[n], some)[1]
            for step, before in zip(reversed(some), reversed(back), strict=True):
                x = int(before[a, b])
                if x >= 0:
                    out.append(step.letters[b])
                    a, b = x, a
        return "".join(reversed(out)), end

    def of_words(self, found: list[str]) -> float:
        get = self.evidence.get
        return max((max(get(w, 0.0), *(get("^" + w[:k], 0.0) for k in PREFIXES if len(w) > k), 0.0) for w in found), default=0.0)

    def of_token(self, token: str) -> float:
        """Evidence of a lower-case token, as it stands and restored."""
        known = self.memo.get(token)
        if known is None:
            known = self.of_words(_WORD.findall(token))
            core = token.strip(_AROUND)
            if _TRIPLE.search(core) or _HIDDEN.search(core):
                known = max(known, self.of_words(_WORD.findall(self.decode(core))))
            if len(self.memo) >= HELD:
                self.memo.clear()
            self.memo[token] = known
        return known

    def of_spaced(self, run: str) -> float:
        joined = self.decode(run)
        inside = max((self.evidence[w] for at in range(len(joined) - 4) for w in self.strong.get(joined[at : at + 5], ()) if joined.startswith(w, at)), default=0.0)
        return max(inside, self.of_words(_WORD.findall(joined)))

    def of_stretch(self, stretch: str) -> float:
        """Evidence of lone characters and what parts them: as one run, without signs at its edges, and run by run where gaps are wide."""
        known = self.stretches.get(stretch)
        if known is None:
            known = self._of_stretch(stretch)
            if len(stretch) <= 64:
                if len(self.stretches) >= HELD // 4:
                    self.stretches.clear()
                self.stretches[stretch] = known
        return known

    def _of_stretch(self, stretch: str) -> float:
        if not _spaced_out(stretch):
            return 0.0
        core = _EDGES.sub("", stretch)
        parts = [_EDGES.sub("", x) for x in _GAP.split(stretch) if _spaced_out(x)]
        found = {x: self.of_spaced(x) for x in {stretch.strip(), core, *parts}}
        return max(*(found[x] for x in (stretch.strip(), core)), sum(found[x] for x in parts))

    def score(self, text: str | None) -> float:
        lower = (text or "").lower()
        total = self.base + sum(map(self.of_token, set(lower.split())))
        total += sum(self.of_stretch(m.group()) for m in _SPACED.finditer(lower))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def _marks(clean: float, toxic: float) -> tuple[Column, Column]:
    """Of a feature's counts n0 and n1: the log ratio of its rates, and the statistic of the test that they are equal."""
    n0, n1 = F.col("n0"), F.col("n1")
    sure = F.greatest(n1 - F.sqrt(n1), F.lit(0.0))
    ratio = F.log((sure + 0.5) / (toxic + 1)) - F.log((n0 + 0.5) / (clean + 1))
    both, total = n0 + n1, float(max(1, clean + toxic))
    cells = ((n1, both * toxic / total), (n0, both * clean / total), (toxic - n1, (total - both) * toxic / total), (clean - n0, (total - both) * clean / total))
    return ratio, sum((F.when((seen > 0) & (due > 0), 2 * seen * F.log(seen / due)).otherwise(0.0) for seen, due in cells), F.lit(0.0))


def _weights(signed: DataFrame) -> DataFrame:
    """(node, weight) of each distinct text of the signatures: one over the rows that are its copies or near copies of one text.

    A text is a near copy of the least text of its buckets if they share ``SHARED`` bands.
    """
    nodes = materialize(signed.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("n").alias("n")), "nodes")
    member = nodes.filter("n > 0").select("node", F.explode("bands").alias("bucket"))
    least = member.groupBy("bucket").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    near = member.join(least, "bucket").filter("node != least").groupBy("node", "least").count().filter(F.col("count") >= SHARED)
    near = near.groupBy("node").agg(F.min("least").alias("least"))
    named = nodes.select("node", "copies").join(near, "node", "left").withColumn("least", F.coalesce("least", "node"))
    return named.join(named.groupBy("least").agg((1 / F.sum("copies")).alias("weight")), "least").select("node", "weight")


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, node, toxic, weight): a row per labelled document and label; no text is shuffled."""
    rows = labels.filter(is_trained_on(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    signed = prob_minhash.signed(docs.filter(is_trained_on(F.col("doc_id")))).drop("owner")
    signed = materialize(signed.join(rows, "doc_id"), "labelled")
    return materialize(signed.select("doc_id", "node", "toxic").distinct().join(_weights(signed), "node"), "marks")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on all labelled documents that ``is_trained_on`` lets through, counted in tasks.

    The driver receives the features kept and at most 28**3 trigram counts.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    marks = _marked(docs, labels).filter("weight > 0")  # all of them; Spark filters texts ahead of a join only where the other side has a predicate
    labelled = docs.withColumn("node", prob_minhash.node_of(F.col("text"))).join(marks, ["doc_id", "node"])
    counts = labelled.select("text", "toxic", "weight").mapInPandas(_count, "kind string, name string, n0 double, n1 double")
    counts = counts.groupBy("kind", "name").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    with settings(docs.sparkSession, {f"spark.sql.optimizer.{k}": v for k, v in prob_minhash.BLOOM.items()}):
        counts = materialize(counts.filter((F.col("kind") != "f") | (F.col("n1") >= MIN_DOCS - 1e-6)), "toxicity")
    totals = counts.filter("kind = 't'").first()
    n0, n1 = (totals["n0"], totals["n1"]) if totals else (0, 0)
    cube = np.full((_BASE, _BASE, _BASE), 0.02)
    for r in counts.filter("kind = 'c'").toLocalIterator():
        cube.flat[int(r["name"])] += r["n0"]
    both = cube.sum(axis=0, keepdims=True)
    mixed = 0.9 * cube / cube.sum(axis=2, keepdims=True) + 0.1 * both / both.sum(axis=2, keepdims=True)
    ratio, surprise = _marks(n0, n1)
    kept = counts.filter("kind = 'f'").select("name", ratio.alias("ratio"), surprise.alias("surprise")).filter((F.col("ratio") > MIN_RATIO) & (F.col("surprise") > SURPRISE))
    evidence = {r["name"]: r["ratio"] for r in kept.toLocalIterator()}
    base = math.log((n1 + 0.5) / (n0 + 0.5)) if n1 and n0 else -4.0
    return Model(np.log(mixed), evidence, min(base, -1.0) - 2.0)


def scorer(model: Model):
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(model.score, na_action=None).astype(float)

    return run


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the toxicity of ``text``, 0 to 1."""
    return docs.withColumn(out, scorer(model)(F.col(text)))


def filter_documents(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with the columns they came with."""
    return score(docs, model, text, "tx_score").filter(F.col("tx_score") < threshold).select(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, train(docs, labels))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", (~is_trained_on(F.col("doc_id"))).alias("held_out"), "score", predicted.alias("predicted"))
