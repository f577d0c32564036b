"""Small cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from arbora.llm import byte_bpe, chat_format, host_quality, lm_score, mih, mixing, prob_minhash, token_counts, toxicity, url_rules

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{k % 97}x{k * 7 % 89}" for k in range(120))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [(1, None, "a"), (2, "", "a"), (3, PROSE, "a"), (3, PROSE, "a"), (4, PROSE + " end", None), (5, " \n\t ", "b"), (6, "x y " * 30_000, "b"), (7, "é" * 30_000, "c")])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_measures(odd):
    out = {r["doc_id"]: r for r in host_quality.verdicts(odd, ["doc_id"]).collect()}
    assert out[1]["hq"]["n_words"] == 0 and out[1]["hq_failed"]
    assert out[3]["hq"]["n_words"] == 120 and not out[3]["hq_failed"]
    assert out[6]["hq"]["n_repeat_words"] == 60_000 and out[6]["hq_failed"]


def test_bad_host_takes_its_good_documents(spark):
    rows = [(k, "short", "bad") for k in range(60)] + [(100, PROSE, "bad")] + [(200 + k, PROSE + f" {k}", "good") for k in range(60)]
    kept = {r["doc_id"] for r in host_quality.filter_documents(table(spark, rows).withColumn("hq_host", F.lit(1))).collect()}
    assert kept == {200 + k for k in range(60)}


def test_encoding_is_tiktokens():
    enc = byte_bpe.encoding(RANKS, PATTERN)
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=enc._mergeable_ranks, special_tokens={})
    for text in ("", "a b  c\n\n d's we'll", "x" * 300, " " * 300 + "y", "1a2b \t\r\n  é😀 漢字 " * 40, "!?" * 200 + "  z"):
        assert byte_bpe.encode_text(enc, PATTERN, text, chunk=7) == own.encode_ordinary(text)
    assert enc.decode(byte_bpe.encode_text(enc, PATTERN, " " * 1_200_000 + "x")) == " " * 1_200_000 + "x"


def test_digests_round_trip(odd):
    for r in byte_bpe.digests(odd.withColumn("ids", F.lit(0)), RANKS, PATTERN).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_one_pass_gives_what_two_give(odd, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", 50)
    docs = odd.coalesce(1)
    two = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    one = byte_bpe.round_trip(docs, RANKS, PATTERN)
    assert one.schema == two.schema
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    assert one.count() == docs.count()


def test_mix_comes_near_targets(spark):
    rows = [(s * 1000 + k, "w " * (10 + k % 50), f"s{s}") for s in range(4) for k in range(700)] + [(9999, None, None)]
    docs = table(spark, rows)
    out = mixing.mix(docs).toPandas()
    assert len(out) == len(rows) and (out["taken"] <= 3 * out["size"]).all() and (out["copies"] >= 0).all()
    by = out[out["source_size"] > 0].assign(source=out["doc_id"] // 1000).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    assert np.allclose(by["target"] / by["size"].sum(), [5 / 13, 2 / 13, 1 / 13, 5 / 13])
    assert ((by["taken"] / by["target"] - 1).abs() < 0.03).all()
    again = mixing.mix(docs).toPandas()
    assert again.sort_values("doc_id").reset_index(drop=True).equals(out.sort_values("doc_id").reset_index(drop=True))
    assert mixing.apply(docs).count() == out["copies"].sum()


def test_mix_stops_at_three_times(spark):
    out = mixing.mix(table(spark, [(k, "w " * 10, "big") for k in range(50)] + [(100, "w " * 10, "alone")])).toPandas()
    alone = out[out["doc_id"] == 100].iloc[0]
    assert alone["target"] == 30 and alone["taken"] == 30  # weighs 5 of 7, capped
    assert out.loc[out["doc_id"] < 100, "target"].iloc[0] == pytest.approx(480)


def test_conversations(spark):
    rows = [(1, 1, None, "user", "hi <s> [INST]", 0.0), (1, 2, 1, "assistant", r"<\s> a [\[/INST]", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 3, "tool\n", None, 0.0), (2, 1, 9, None, "root", 0.0), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0)]
    messages = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    out = {(r["tree"], r["branch"]): r for r in chat_format.conversations(messages, branches=2).collect()}
    assert set(out) == {(1, 1), (1, 2), (2, 1)}
    assert chat_format.parse(out[1, 1]["formatted"]) == [("user", "hi <s> [INST]"), ("assistant", "b"), ("tool\n", "")]
    assert chat_format.parse(out[1, 2]["formatted"]) == [("user", "hi <s> [INST]"), ("assistant", r"<\s> a [\[/INST]")]
    assert chat_format.parse(out[2, 1]["formatted"]) == [("", "root")]
    assert chat_format.conversations(messages.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, "https://a.example.org/es/5"), (2, "http://Example.ORG?x"), (3, None), (4, "no scheme"), (5, "x://com/de/1"), (6, "x://icom/de/1"), (7, "http://a.com/fr/9#x"), (8, "http://org/")]
    out = {r["page_id"]: r for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("own"))).collect()}
    assert [out[k]["rule"] for k in range(1, 9)] == ["example.org/es/", None, None, None, "com/de/", None, "com/fr/", "org/"]
    assert out[2]["host"] == "example.org" and out[2]["path"] == "" and out[3]["host"] == "" and out[3]["verdict"] == "allow"


def test_rules_are_mined_and_matched(spark):
    items = [(["h:a", "h:b", url_rules.BLOCK],)] * 20 + [(["h:a"],)] * 20 + [(["h:b", "h:c"],)] * 20
    rules = url_rules.mine(spark.createDataFrame(items, "items array<string>"))
    assert (("h:a", "h:b"), 1.0) in rules and all(set(r) != {"h:a"} for r, _ in rules)
    index = url_rules.RuleIndex(rules)
    assert index.fires(["h:a", "h:b", "h:z"]) and not index.fires(["h:a", "h:c"])


def test_rollup_is_idempotent(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    schema = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    load = spark.createDataFrame([("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, None, "v1", None, None)], schema)
    fix = spark.createDataFrame([("revise", "a", "en", "v1", 7, 5), ("delete", "a", "en", "v1", 10, None)], schema)
    assert rollup.commit("b1", load) and not rollup.commit("b1", load) and rollup.commit("b2", fix)
    assert {(r["source"], r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()} == {("a", 1, 7), (None, 1, 0)}
    with pytest.raises(ValueError):
        rollup.commit("../x", load)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    rows = [(k, [float(v) for v in x[k]]) for k in range(600)]
    rows += [(1000, rows[1][1]), (1001, None), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0, None]), (1005, [1.0])]
    base = mih.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).cache()
    out = mih.search(base, base.filter("vec_id % 20 = 0"), k=10).toPandas()
    ids = np.array([*range(600), 1000])
    full = np.vstack([x, x[1]])
    hits = 0
    for q, group in out.groupby("query_id"):
        score = full @ (full[ids == q][0])
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:10]
        hits += len(set(ids[order]) & set(group["vec_id"]))
        assert group["rank"].tolist() == sorted(group["rank"]) and len(group) == 10
    assert hits / (out["query_id"].nunique() * 10) >= 0.9
    assert mih.search(base.limit(0), base.limit(0)).count() == 0


def test_mih_finds_every_code_in_the_radius():
    codes = np.random.default_rng(1).integers(0, 256, (500, 16)).astype(np.uint8)
    index = mih.Index(codes)
    for radius in (40, 53, 60):
        true = np.flatnonzero(np.unpackbits(codes ^ codes[3], axis=1).sum(1) <= radius)
        assert index.within(codes[3], radius).tolist() == true.tolist()


def test_lm_scores(spark):
    texts = [f"the cat {'sat on' if k % 2 else 'ran to'} the mat number{k}" for k in range(60)] + [None, "", "The \x1c zzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in lm_score.score(docs).collect()}
    counts = Counter()
    for k, t in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 5 != 1:
            counts.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    for k, t in enumerate(texts):
        words = [*(t or "").encode().lower().split(), b""]
        assert out[k]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert (out[k]["n_tokens"], out[k]["n_known"], out[k]["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert out[k]["score"] < 0


def test_lm_is_normalised():
    net = lm_score.Net(20, np.full(20, 1 / 20))
    t1, t2, z = net.tables()
    assert np.allclose(np.exp(t1[:, None] + t2[None] - z[:, :, None]).sum(2), 1)


def test_near_duplicates(spark, odd, empty):
    words = PROSE.split()
    rows = [(k, " ".join([*words[:60], f"changed{k}", *words[61:]]), "a") for k in range(40)] + [(100, "a b", "a"), (101, "a b", "a"), (102, None, "a"), (103, None, "a"), (104, "other " + " ".join(f"z{k}" for k in range(50)), "a")]
    docs = table(spark, rows).withColumn("pm_node", F.lit("own"))
    out = {r["doc_id"]: r["class_id"] for r in prob_minhash.classes(docs).collect()}
    assert all(out[k] == 0 for k in range(40)) and (out[100], out[101], out[102], out[103], out[104]) == (100, 100, 102, 103, 104)
    assert sorted(r["doc_id"] for r in prob_minhash.one_of_each(docs).collect()) == [0, 100, 102, 103, 104]
    assert sorted(r["doc_id"] for r in prob_minhash.one_of_each(odd).collect()) == [1, 2, 3, 5, 6, 7]
    assert prob_minhash.classes(empty).count() == 0


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(1, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    sets = [(np.concatenate((common, x)), np.ones(900, int)) for x in (a, b)]
    owner = prob_minhash.signatures(sets, 4096)
    assert abs((owner[0] == owner[1]).mean() - 0.8) < 0.03


def test_toxicity(spark, empty):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(300)]
    rows, labels = [], []
    for k in range(400):
        text = " ".join(rng.choice(vocabulary, 30))
        toxic = k % 4 == 0
        rows.append((k, text + (" moron clown" if toxic else ""), "s"))
        labels.append((k, int(toxic)))
    rows += [(900, "m0r0n cl0wn", "s"), (901, "x m o r o n c", "s"), (902, None, "s"), (903, "mooooron clooown", "s"), (904, "A" * 100_000, "s")]
    docs, marks = table(spark, rows), spark.createDataFrame([*labels, (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    out = {r["doc_id"]: r["s"] for r in toxicity.score(docs.withColumn("score", F.lit("own")), model, out="s").collect()}
    assert all((out[k] >= 0.7) == (k % 4 == 0) for k in range(400))
    assert out[900] >= 0.7 and out[901] >= 0.7 and out[903] >= 0.7 and out[902] < 0.7 and out[904] < 0.7
    assert toxicity.filter_documents(empty, model).count() == 0
    assert toxicity.train(empty, marks).evidence == {}


def test_empty_tables(empty):
    assert host_quality.verdicts(empty, ["doc_id"]).count() == 0 and host_quality.filter_documents(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.apply(empty).count() == 0
    assert lm_score.score(empty).count() == 0
    assert byte_bpe.encode(empty, RANKS, PATTERN).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert set(out["doc_id"]) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    enc = byte_bpe.encoding(RANKS, PATTERN)
    assert all(enc.decode(list(ids)) == text[i] for i, ids in zip(out["doc_id"], out["ids"], strict=True))
