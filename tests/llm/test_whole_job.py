"""Cases that a shortened job gets wrong."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import lm_score, prob_minhash, toxicity, url_rules


def _model(word: str, seed: int = 0) -> toxicity.Model:
    """A character model in which a word is likely, once its letters are known."""
    cube = np.random.default_rng(seed).dirichlet(np.full(28, 0.3), (28, 28)) + 1e-6
    codes = [26, 26, *(ord(c) - 97 for c in word), 26]
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        cube[a, b] = 1e-4
        cube[a, b, c] = 1.0
    return toxicity.Model(np.log(cube), {word: 9.0}, -4.0)


def _all_paths(model: toxicity.Model, token: str) -> float:
    """Log probability of the best path, every state kept."""
    best, run, last = {(26, 26): 0.0}, 0, ""
    for c in token:
        run, last = run + 1 if c == last else 1, c
        choices = {c: 0.0 if c in toxicity._CODES else -1.0 if c.isalpha() else -6.0} | {x: -1.5 if len(toxicity.LEET[c]) < 3 else -2.0 for x in toxicity.LEET.get(c, "")}
        skip = -0.1 if c in toxicity.SEPARATORS else -0.3 if run > 2 else -4.0 if run == 2 else -math.inf
        new = {s: p + skip for s, p in best.items()}
        for (a, b), p in best.items():
            for x, cost in choices.items():
                k = toxicity._CODES.get(x, 27)
                new[b, k] = max(new.get((b, k), -math.inf), p + cost + model.trigram[a, b, k])
        best = new
    return max(p + model.trigram[a, b, 26] for (a, b), p in best.items())


def test_wildcards_are_decoded_over_every_state():
    late = np.full((28, 28, 28), 1e-3)
    late[26, 26, :20] = late[:20, :20, :20] = 0.05
    late[26, 26, 25] = late[26, 25, 24] = late[25, 24, 23] = 1e-3  # unlikely letters until the end of the word
    late[24, 23, 22] = 1.0
    late[24, 23, [k for k in range(28) if k != 22]] = 1e-9
    late[:, :23, 22] = 1e-12
    model = toxicity.Model(np.log(late), {}, -4.0)
    assert model.decode("z##w") == "zyxw"


@pytest.mark.parametrize("token", ["m#r#n", "m*-*on##", "1#0.c*k", "f##k.#4", "m0r0n", "mooo-r..0n!!", "13.37-$t@$h", "7.7.7.7", "aa11bb!!(c)"])
def test_decoding_is_the_best_path(token, monkeypatch):
    model = _model("moron")
    whole, held = model.decode(token), toxicity.STRIDE
    score, (a, b) = 0.0, (26, 26)
    best = _all_paths(model, token)
    for x in whole:
        k = toxicity._CODES.get(x, 27)
        score, a, b = score + model.trigram[a, b, k], b, k
    assert score + model.trigram[a, b, 26] >= best  # costs of the choices only take away
    monkeypatch.setattr(toxicity, "STRIDE", 2)
    assert held > 2 and model.decode(token) == whole


@pytest.mark.parametrize("text", ["m" + "o" * 90 + "ron", "m   o   r   o   n", "(m o r o n)!!", "m\t\t\to\tr  .  o n", "m 0 r 0 n", "m * r o n"])
def test_stretched_and_spaced_words_are_found(text):
    assert _model("moron").score(f"so {text} said") > 0.9


def test_every_labelled_row_is_learnt_from(spark):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(3000)]
    shared, rng = " ".join(words[:40]), np.random.default_rng(4)
    rows, labels = [], []
    for k in range(600):
        own = " ".join(rng.choice(words[100:], 40))
        rows.append((k, f"{shared} {own}" + (" grobian" if k % 30 == 0 else "")))
        labels.append((k, int(k % 30 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = [k for k, in docs.filter(toxicity.is_trained_on(F.col("doc_id"))).select("doc_id").collect()]
    toxic = sum(k % 30 == 0 for k in seen)
    model = toxicity.train(docs, marks)
    assert "grobian" in model.evidence
    assert model.base == pytest.approx(math.log((toxic + 0.5) / (len(seen) - toxic + 0.5)) - 2.0)


def test_more_labels_than_a_draw_are_all_learnt_from(spark):
    """70,000 short texts, which a draw of 40,000 would cut; the counts behind the log odds are those of every row."""
    docs = spark.range(0, 70_000, 1, 8).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text"), F.hex("id")).alias("text"))
    marks = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    n0, n1 = (docs.join(marks, "doc_id").filter(toxicity.is_trained_on(F.col("doc_id")) & (F.col("toxic") == k)).count() for k in (0, 1))
    assert n0 + n1 > 40_000
    assert toxicity.train(docs, marks).base == pytest.approx(math.log((n1 + 0.5) / (n0 + 0.5)) - 2.0, abs=1e-9)


def test_rare_labels_keep_their_words(spark):
    """A feature of a hundredth of the toxic rows, and one that more clean than toxic rows have."""
    rows = spark.createDataFrame([(499.0, 0.0), (50_000.0, 60_000.0), (5.0, 100.0)], "n1 double, n0 double")
    ratio, surprise = toxicity._marks(10_000_000, 100_000)
    assert [r["a"] > toxicity.MIN_RATIO and r["b"] > toxicity.SURPRISE for r in rows.select(ratio.alias("a"), surprise.alias("b")).collect()] == [True, True, False]


def test_repeated_lines_do_not_hide_near_copies(spark):
    """Equal shingle sets, one with a passage repeated 1000 times, against brute force."""
    rows = []
    for k in range(40):
        line = " ".join(f"p{k}x{j}" for j in range(20))
        rest = " ".join(f"r{k}x{j}" for j in range(75))
        rows += [(2 * k, f"{line} {line} {rest}"), (2 * k + 1, " ".join([line] * 1000) + f" {rest}")]
    sets = {k: set(prob_minhash.shingles([t.encode()])[0][0].tolist()) for k, t in rows}
    assert all(sets[2 * k] == sets[2 * k + 1] for k in range(40))
    out = {r["doc_id"]: r["class_id"] for r in prob_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {k: k // 2 * 2 for k, _ in rows}


def test_start_texts_are_whole(spark):
    texts = [f"w{k} " * 3000 + "last" for k in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(lm_score.start_texts(lm_score._rows(docs), 5, 15_010)) == sorted(t.encode() for t in texts)


def test_rules_of_four_tokens_fire(spark):
    """Only all four tokens together mark a block; any three are as often allowed."""
    four = ["h:a", "h:b", "p:c", "p:d"]
    items = [([*four, url_rules.BLOCK],)] * 20 + [([x for x in four if x != gone],) for gone in four] * 20
    rules = url_rules.mine(spark.createDataFrame(items, "items array<string>"))
    assert [r[0] for r in rules] == [tuple(four)]
    assert url_rules.RuleIndex(rules).fires([*four, "p:e"])


def _brute_classes(rows: list[tuple[int, str | None]], threshold: float = 0.8) -> dict[int, int]:
    """Class of each document by the exact Jaccard of all pairs of word shingles that share one."""
    sets: dict[int, frozenset] = {}
    for k, text in rows:
        words = (text or "").encode().lower().split()
        sets[k] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    up = {k: k for k in sets}

    def root(k: int) -> int:
        while up[k] != k:
            k = up[k]
        return k

    by_shingle: dict[tuple, list[int]] = {}
    for k, own in sets.items():
        for x in own:
            by_shingle.setdefault(x, []).append(k)
    met: Counter = Counter()
    for held in by_shingle.values():
        met.update((a, b) for i, a in enumerate(held) for b in held[i + 1 :])
    for (a, b), n in met.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {k: root(k) for k in sets}


def test_classes_are_those_of_brute_force(spark):
    """A whole table; every document's class, and by it the recall of near copies."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = _brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r["class_id"] for r in prob_minhash.classes(docs).collect()}
    near = [k for k, c in want.items() if k != c]
    assert len(near) > 20
    assert got == want


def test_blocks_and_the_shuffled_plan_give_the_same_classes(spark, monkeypatch):
    """Chains of texts that are linked through neighbours only, cut into many blocks, without a broadcast."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[2 * k : 2 * k + 100])) for k in range(120)]  # neighbours share 94 of 98 shingles
    rows += [(1000 + k, " ".join([*words[:60], *(f"o{k}x{j}" for j in range(40))])) for k in range(60)]  # a shared passage, no copies
    monkeypatch.setattr(prob_minhash, "BLOCK", 8)
    monkeypatch.setattr(prob_minhash, "BLOCK_SHINGLES", 900)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {r["doc_id"]: r["class_id"] for r in prob_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert got == _brute_classes(rows)


def test_urls_against_brute_force(spark):
    """Every page of a table: host, path, longest rule, and the mined verdict, by plain loops."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    index = url_rules.learn(pages)
    for r in url_rules.judge(pages).collect():
        url = r["url"] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.split(r"[/?#]", rest)[0].lower() if rest else ""
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        items = [f"h:{x}" for x in host.split(".") if x] + [f"p:{x[0] + '#' * (len(x) - 1) if re.fullmatch('[0-9]+', x) else x}" for x in re.split(r"[^0-9A-Za-z\x80-\U0010ffff]+", path) if x]
        items += [f"q:{x.split('=')[0]}" for x in url.partition("#")[0].partition("?")[2].split("&") if x]
        _, rule, verdict = max(fits, default=(0, None, "block" if index.fires(items) else "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_mined_rules_hold_on_urls_left_out(spark):
    """Rules from four fifths of the pages, against the hand-written verdicts of the last fifth."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    fold = F.crc32(F.col("page_id").cast("string").cast("binary")) % 5
    index = url_rules.learn(pages.filter(fold != 1))
    parts = pages.filter(fold == 1).select("url", url_rules.host_of(F.col("url")).alias("host"), url_rules.path_of(F.col("url")).alias("path"))
    items = url_rules.tokens(F.col("url"), F.col("host"), F.col("path"))
    both = parts.select(url_rules.by_hand(F.col("host"), F.col("path"))[1].alias("want"), url_rules.mined_verdict(index, items).alias("got")).filter("want IS NOT NULL")
    n, right = both.count(), both.filter("want = got").count()
    print(f"mined verdicts right on {right} of {n} URLs left out")
    assert n > 100 and right / n >= 0.95


def test_many_urls_of_one_long_path_are_mined_in_time(spark):
    long = "http://big.com/de/" + "/".join(f"part{k}" for k in range(30))
    rows = [(k, long + f"?id={k}") for k in range(400)] + [(1000 + k, f"http://other.org/x{k % 7}/y") for k in range(400)] + [(2000, "http://big.net/" + "a" * 200_000), (2001, "http://sub.net/part7?x"), (2001, "http://sub.net/part7?x")]
    out = [(r["page_id"], r["verdict"]) for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect() if r["page_id"] >= 2000]
    assert sorted(out) == [(2000, "block"), (2001, "block"), (2001, "block")] or sorted(out) == [(2000, "allow"), (2001, "block"), (2001, "block")]
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert [r["verdict"] for r in url_rules.judge(spark.createDataFrame([(1, None)], "page_id long, url string")).collect()] == ["allow"]


def test_components_of_paths_stars_and_random_edges(spark):
    rng = np.random.default_rng(3)
    names = [f"{x:08d}".encode() for x in rng.permutation(400)]
    edges = [(i, i + 1) for i in range(90)] + [(100, i) for i in range(101, 180)] + [tuple(rng.integers(200, 300, 2).tolist()) for _ in range(60)]
    edges += [(1, 0), (5, 5), (310, 311)]
    root = list(range(400))
    of = lambda i: i if root[i] == i else of(root[i])
    for a, b in edges:
        root[of(a)] = of(b)

    def expected(edges):
        groups = {}
        for i in {i for e in edges if e[0] != e[1] for i in e}:
            groups.setdefault(of(i), []).append(i)
        return {names[i]: min(names[j] for j in g) for g in groups.values() for i in g}

    table = lambda edges: spark.createDataFrame([(bytearray(names[a]), bytearray(names[b])) for a, b in edges], "a binary, b binary")
    read = lambda df: {bytes(r["node"]): bytes(r["label"]) for r in df.collect()}
    labels = prob_minhash.components(table(edges))
    assert read(labels) == expected(edges)
    more = [(0, 110), (320, 321), (321, 310), (330, 331)]
    for a, b in more:
        root[of(a)] = of(b)
    assert read(prob_minhash._extended(labels, table(more))) == expected(edges + more)
    assert prob_minhash.components(table([])).count() == 0
