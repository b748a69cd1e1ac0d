from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sluicebox.operators import metrics, models
from sluicebox.operators.order import running_before
from sluicebox.operators.parts import parts_within, with_parts
from sluicebox.sources import files
from sluicebox.sources.small import copy_report, read_text

PAIRS = [(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 4


def f1(tp, fp, fn):
    return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0


def test_metrics_by_hand(spark):
    rows = [("a", t, g) for t, g in PAIRS] + [("b", 1, 1)] * 2 + [("c", 0, 1)]
    df = spark.createDataFrame(rows, "k string, truth int, guess int")
    out = {r.k: r for r in metrics.metrics(metrics.confusion(df, ["k"]), ["k"]).collect()}
    assert (out["a"].accuracy, out["a"].precision, out["a"].recall, out["a"].f1) == (0.7, 0.6, 0.75, f1(3, 2, 1))
    assert out["a"].macro_f1 == pytest.approx((f1(3, 2, 1) + f1(4, 1, 2)) / 2) and out["a"].support == 10
    assert out["b"].macro_f1 == 1.0 and (out["c"].precision, out["c"].recall, out["c"].macro_f1) == (0.0, 0.0, 0.0)


def test_conditions(spark):
    rows = [(d, s) for d in ("real", "synthetic") for s in ("train", "validation", "test")]
    got = sorted((r.condition, r.role, r.dataset) for r in metrics.conditions(spark.createDataFrame(rows, "dataset string, split string")).collect())
    assert got == sorted([("A", "train", "real"), ("B", "train", "synthetic"), ("C", "train", "real"), ("C", "train", "synthetic"), ("A", "validation", "real"), ("B", "validation", "synthetic"), ("C", "validation", "real"), *[(c, "test", "real") for c in "ABC"]])


VOCAB = [("safe", 0, [1.0, 2.0, 3.0]), ("x", 1, [3.0, 0.0, 1.0])]


def test_features(spark):
    vocab = spark.createDataFrame(VOCAB, "token string, index int, vector array<float>")
    rows = spark.createDataFrame([(1, ["safe", "missing"]), (2, ["x", "x", "safe"]), (3, []), (4, ["q"]), (5, ["x"] * 300)], "k int, tokens array<string>")
    ids = {r.k: r.ids for r in metrics.token_ids(rows, "k", "tokens", vocab).collect()}
    assert all(len(x) == 200 for x in ids.values()) and ids[1][:3] == [1, 0, 0] and ids[2][:4] == [2, 2, 1, 0] and set(ids[3]) == {0} and set(ids[5]) == {2}
    each = rows.select("k", F.explode_outer("tokens").alias("token"))
    got = {}
    for r in metrics.mean_pool(each, "k", vocab, 3).collect():
        got.setdefault(r.k, {})[r.dim] = r.value
    assert got[1] == {0: 1.0, 1: 2.0, 2: 3.0} and got[2] == {0: 7 / 3, 1: 2 / 3, 2: 5 / 3} and got[3] == got[4] == {0: 0.0, 1: 0.0, 2: 0.0} and got[5] == {0: 3.0, 1: 0.0, 2: 1.0}
    matrix = {r.id: r.vector for r in models.embedding_rows(vocab.select("token", "vector"), vocab.select("token", "index")).collect()}
    assert matrix == {0: [0.0, 0.0, 0.0], 1: [1.0, 2.0, 3.0], 2: [3.0, 0.0, 1.0]}


def test_vocabulary_order(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "c"],), (["a", "d"],), ([],), (None,)], "t array<string>")
    assert [tuple(r) for r in metrics.vocabulary(rows, "t", 1).orderBy("index").collect()] == [("a", 0, 2), ("b", 1, 2), ("c", 2, 1), ("d", 3, 1)]


def test_running_sums_with_many_equal_and_null_keys(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, None, 1, 2]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int, w int").repartition(5)
    got = {r.i: r.at for r in running_before(df, [F.col("k"), F.col("i")], F.col("w"), "at").collect()}
    at, want = 0, {}
    for k, i, w in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want[i], at = at, at + w
    assert got == want
    assert running_before(df.where("false"), [F.col("k")], F.col("w")).collect() == []


def test_chunks_of_a_corpus(spark):
    rows = [(None, "A b"), (5, "c d e"), (10**15, ""), (None, "A b"), (3, None), (7, "f " * 7)]
    got = files.corpus_chunks(spark.createDataFrame(rows, "k bigint, t string"), ["k"], F.col("t"), 4).orderBy("chunk").collect()
    import hashlib

    stream = ["a", "b", "a", "b", "c", "d", "e", *["f"] * 7]
    assert [(r.n_tokens, r.text_sha) for r in got] == [(len(stream[i : i + 4]), hashlib.sha256(" ".join(stream[i : i + 4]).encode()).hexdigest()) for i in range(0, len(stream), 4)]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_parts_both_ways(spark, limit):
    parts = spark.createDataFrame([(1, "one two three four five six seven"), (2, "short"), (3, None), (4, ""), (5, "short"), (6, "two three four five six seven eight nine"), (7, "a\nb")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine short"), (2, "shorts"), (3, None), (4, ""), (5, "one  two three four five six seven"), (6, "a\nb c")], "doc_id bigint, text string")
    want = {1: ["one two three four five six seven", "short", "short", "two three four five six seven eight nine"], 2: ["short", "short"], 3: [], 4: [], 5: [], 6: ["a\nb"]}
    assert {r.doc_id: r.parts for r in with_parts(docs, parts, broadcast_bytes=limit).collect()} == want
    assert {r.doc_id: r.parts for r in parts_within(docs, parts, broadcast_bytes=limit).collect()} == {k: v for k, v in want.items() if v}


def test_models_learn_what_can_be_learnt(spark):
    rng = random.Random(4)
    words = {0: ["open", "read", "close"], 1: ["eval", "exec", "shell"]}
    rows = [(i, [rng.choice(words[i % 2] + ["x", "y"]) for _ in range(12)], float(i % 2)) for i in range(160)]
    df = spark.createDataFrame(rows, "k int, tokens array<string>, label double").repartition(2)
    vectors = models.word_vectors(df, width=8, least=2, epochs=3, seed=1)
    assert {r.token for r in vectors.collect()} == {w for ws in words.values() for w in ws} | {"x", "y"}
    feats = models.pooled_features(df, vectors, "k", 8).cache()
    train, test = feats.where("k < 120"), feats.where("k >= 120")
    for out in (models.forest(train, test, trees=15, seed=1), models.perceptron(train, test, 8, hidden=(6,), rounds=60, seed=1)):
        got = out.select((F.col("guess") == F.col("label").cast("int")).alias("ok")).collect()
        assert len(got) == 40 and sum(r.ok for r in got) >= 36
    p = test.select("k", F.col("label").alias("p"))
    assert all(r.guess == int(r.label) for r in models.external(test, p, "k").collect())
    with pytest.raises(Exception, match="no prediction"):
        models.external(test, p.where("k > 130"), "k").collect()


def test_metric_files(spark, tmp_path):
    rows = [("sql", "A", "forest", 0.5, 0.5, 0.5, 0.5, 0.25, 4, 2), ("xss", "A", "forest", 1.0, 1.0, 1.0, 1.0, 0.75, 4, 2)]
    schema = "mode string, condition string, model string, accuracy double, precision double, recall double, f1 double, macro_f1 double, support long, positive_support long"
    files.write_metrics(spark.createDataFrame(rows, schema), f"file://{tmp_path}/m")
    assert "| forest | A | 0.5000 |" in read_text(spark, f"file://{tmp_path}/m/comparison.md")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/m/metrics.csv").count() == 2 and '"macro_f1": 0.25' in read_text(spark, f"file://{tmp_path}/m/metrics.json")
    assert copy_report(spark, f"file://{tmp_path}/m/comparison.md", f"file://{tmp_path}/c/r.md") and not copy_report(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/c/x")
    feats = files.write_features(spark.createDataFrame([("sql", "real", "train", "pooled", 1), ("xss", "real", "test", "pooled", 2)], "mode string, dataset string, split string, form string, v int"), f"file://{tmp_path}/f")
    assert [r.v for r in feats.where("mode = 'xss'").collect()] == [2]
