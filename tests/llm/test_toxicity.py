from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicebox.llm import toxicity
from sluicebox.llm.toxicity import CODE, SIZE, Scorer, best_threshold, fit, lattice, log_model, restore, toxic_documents, trigram_counts, without_toxic

PLAIN = "the river runs past the mill and the garden where letters are written every summer morning by the clerk of the market".split()
RUDE = ["clown", "moron", "trash", "idiot", "scum"]


def cls(c):
    return CODE.get(c, SIZE - 1 if c.isalpha() and ord(c) > 127 else 0)


def brute_counts(texts):
    out = {}
    for t in texts:
        if t:
            x = [0, 0, *(cls(c) for c in t.lower()), 0]
            for a, b, c in zip(x, x[1:], x[2:]):
                k = (a * SIZE + b) * SIZE + c
                out[k] = out.get(k, 0) + 1
    return out


def test_trigrams_equal_a_count_by_hand(messy):
    texts = [r[0] for r in messy.select("text").collect()]
    assert {r.gram: r.n for r in trigram_counts(messy).collect()} == brute_counts(texts)


def model_of(words):
    counts = brute_counts([" ".join(words)])
    return log_model(np.array(list(counts)), np.array(list(counts.values()), dtype=float), dict.fromkeys(RUDE, 1.0))


def exhaustive(token, model):
    """The best score over all readings of the lattice."""
    best = -math.inf
    for path in itertools.product(*lattice(token)):
        s, x, y = 0.0, 0, 0
        for text, cost in path:
            s += cost
            for c in text:
                k = 0 if c == " " else CODE.get(c, SIZE - 1)
                s += float(model[x, y, k])
                x, y = y, k
        best = max(best, s + float(model[x, y, 0]))
    return best


def score_of(token, reading, model):
    return max(s for s, r in readings(token, model) if r == reading)


def readings(token, model):
    for path in itertools.product(*lattice(token)):
        s, x, y = 0.0, 0, 0
        for text, cost in path:
            s += cost
            for c in text:
                k = 0 if c == " " else CODE.get(c, SIZE - 1)
                s += float(model[x, y, k])
                x, y = y, k
        yield s + float(model[x, y, 0]), "".join(t for t, _ in path).strip()


@pytest.mark.parametrize("seed", range(4))
def test_the_search_finds_the_best_of_all_readings(seed):
    rng = random.Random(seed)
    model = model_of(PLAIN * 20)
    for _ in range(40):
        token = "".join(rng.choice("clowntrasmidexyz0134578@$!|(.-é") * rng.choice((1, 1, 1, 2, 4)) for _ in range(rng.randint(1, 6)))
        assert score_of(token, restore(token, model), model) == pytest.approx(exhaustive(token, model), abs=1e-4)


def docs_and_labels(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(PLAIN) for _ in range(40)]
        if i % 4 == 0:
            for w in rng.sample(RUDE, 1 + i % 8 // 4):
                words.insert(rng.randrange(40), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    hidden = ["cl0wn", "m o r o n", "tr@sh", "1d10t", "$cum", "clooooown", "m.o.r.o.n", "t-r-a-s-h", "traash", "mooron", "(lown", "m/o/r/o/n", "s|c|u|m", "i,d,i,o,t", "scàm scum"]
    for k, h in enumerate(hidden):
        words = [rng.choice(PLAIN) for _ in range(20)]
        rows.append((1000 + k, " ".join([*words[:9], h, *words[9:]])))
    clean = ["room 101 at 10:30 costs $45", "a b c d e", "letter (the summer) is written", "1 2 3 4 5 6", "www.mill.example/garden?x=1", "e-mail: clerk@market.example", "x | y | z", "zzz 1,000.00"]
    rows += [(2000 + k, " ".join(PLAIN) + " " + c) for k, c in enumerate(clean)]
    rows += [(3000, None), (3001, ""), (None, "the moron"), (3002, "moron " * 50_000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("toxicity", F.lit("mine")), spark.createDataFrame(labels, "doc_id bigint, toxic int"), hidden, clean


def test_planted_cases_and_clean_ones(spark):
    docs, labels, hidden, clean = docs_and_labels(spark)
    got = {r.doc_id: r for r in toxic_documents(docs, labels).collect()}
    assert {i for i in got if i is not None and i < 400} == {i for i in range(400) if i % 4 == 0}
    missed = [h for k, h in enumerate(hidden) if 1000 + k not in got]
    assert not missed
    assert all(got[1000 + k].restored > 0 for k, h in enumerate(hidden) if "scum" not in h.split())
    assert not [c for k, c in enumerate(clean) if 2000 + k in got]
    assert 3000 not in got and 3001 not in got and None in got and got[3002].hits == 50_000


def test_scores_equal_a_scorer_on_the_driver(spark):
    docs, labels, *_ = docs_and_labels(spark)
    fitted = fit(docs, labels)
    want = {}
    for r in docs.collect():
        s = fitted.scorer.score(r.text)
        if s[0] >= fitted.threshold:
            want[r.doc_id] = s
    assert {r.doc_id: (r.score, r.hits, r.restored) for r in toxic_documents(docs, labels).collect()} == want


def test_weights_equal_counts_by_hand(spark):
    docs, labels, *_ = docs_and_labels(spark)
    texts = {}
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    for r in docs.collect():
        if r.text is not None and r.doc_id in marks:
            texts[r.text] = max(texts.get(r.text, 0), marks[r.doc_id])
    n, t = len(texts), sum(texts.values())
    words = {}
    for w in {w for x in texts for w in re.split(r"[\W_]+", x.lower()) if len(w) > 2}:
        have = [y for x, y in texts.items() if w in re.split(r"[\W_]+", x.lower())]
        if sum(have) >= toxicity.LEAST_TOXIC and sum(have) / len(have) >= toxicity.LEAST_SHARE and toxicity._tail(sum(have), len(have), t / n) <= toxicity.SIGNIFICANCE:
            words[w] = math.log(((sum(have) + 0.5) / (t + 1)) / ((len(have) - sum(have) + 0.5) / (n - t + 1)))
    assert words and fit(docs, labels).scorer.words == pytest.approx(words)


def test_rows_are_kept_whole(spark):
    docs, labels, *_ = docs_and_labels(spark)
    bad = {r.doc_id for r in toxic_documents(docs, labels).collect()}
    out = without_toxic(docs, labels)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id not in bad or r.text is None)


def test_more_texts_than_the_bound_and_ids_shared_by_many(spark):
    docs, labels, *_ = docs_and_labels(spark)
    many = docs.union(docs.select(F.lit(4).cast("bigint"), F.concat("text", F.lit(" end")), "toxicity").where("doc_id < 400"))
    assert fit(many, labels, rows=100).threshold > 0
    assert fit(docs, labels, rows=100).scorer.words.keys() <= set(RUDE)


def test_without_labels_nothing_is_toxic(spark, messy, empty, nulls):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 0)], "doc_id bigint, toxic int")
    for d in (messy, empty, nulls):
        for y in (none, odd):
            assert toxic_documents(d, y).collect() == []
            assert without_toxic(d, y).count() == d.count()


def test_best_threshold_by_hand():
    assert best_threshold([(3.0, 1), (2.0, 1), (1.0, 0), (0.0, 1)]) == pytest.approx(1.5)
    assert best_threshold([(0.0, 1), (0.0, 0)]) == math.inf


def test_memory_of_a_worker_does_not_change_results(monkeypatch):
    model = model_of(PLAIN * 5)
    text = " ".join(["cl0wn", "tr@sh", *PLAIN] * 3)
    a = Scorer(dict.fromkeys(RUDE, 1.0), {}, model).score(text)
    monkeypatch.setattr(toxicity, "REMEMBERED", 2)
    assert Scorer(dict.fromkeys(RUDE, 1.0), {}, model).score(text) == a
