from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from test_decontam import words
from test_linededup import brute as line_bits
from test_packing import brute as packed
from test_packing import got as windows
from test_simhash import groups

import corpus_pipeline
from sluicebox.llm import common, simhash, toxicity
from sluicebox.llm.common import WORD, digest
from sluicebox.llm.simhash import MIN_WORDS, PAIR_RADIUS, RADIUS, fingerprint, keep_one, near_groups
from sluicebox.llm.toxicity import toxic_documents

DATA = "/root/testdata/sf0.01"


def near_brute(docs):
    """The groups of two or more documents, by all pairs of fingerprints."""
    rows = [tuple(r) for r in docs.where("text is not null").select("doc_id", digest().alias("g"), "text").distinct().collect()]
    nodes = [r for r in rows if WORD.findall(r[2].lower())]
    prints = []
    for _, _, t in nodes:
        w = WORD.findall(t.lower())
        prints.append(tuple(x & (2**64 - 1) for x in fingerprint(w)) if len(w) >= MIN_WORDS else tuple(w))
    edges = []
    for i, a in enumerate(prints):
        for j in range(i):
            b = prints[j]
            if isinstance(a[0], int) and isinstance(b[0], int):
                near = (a[0] ^ b[0]).bit_count() <= RADIUS and (a[1] ^ b[1]).bit_count() <= PAIR_RADIUS
            else:
                near = a == b
            if near:
                edges.append((i, j))
    return [[nodes[i] for i in g] for g in groups(range(len(nodes)), edges) if len(g) > 1]


def check_groups(docs):
    rows = near_groups(docs).collect()
    got = {}
    for r in rows:
        got.setdefault((r.keeper_id, r.keeper_digest), set()).add((r.doc_id, r.digest))
    want = {}
    for g in near_brute(docs):
        members = sorted(((d, s) for d, s, _ in g), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        want[members[0]] = set(members)
    assert got == want and len(rows) == sum(map(len, want.values()))
    return want


def test_near_groups_equal_all_pairs(spark, messy, empty, nulls):
    want = check_groups(messy)
    assert any(len(g) > 1 for g in want.values())
    base = "the quick brown fox jumps over the lazy dog near the old stone bridge while the river keeps running to the sea and nobody looks up"
    rows = [(1, base), (2, base + " today"), (3, base.upper() + "!"), (4, "Stop it"), (5, "stop, IT"), (6, "it stop"), (7, "stop"), (8, "..."), (9, "???"), (None, base), (10, "one two three four"), (11, "one two three five")]
    found = check_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {4, 5} in [{d for d, _ in g} for g in found.values()] and {1, 3, None} <= set.union(*[{d for d, _ in g} for g in found.values()])
    assert near_groups(empty).collect() == near_groups(nulls).collect() == []
    assert keep_one(empty).collect() == [] and keep_one(nulls).count() == 3


def test_near_groups_of_a_given_table(spark):
    check_groups(spark.read.parquet(f"{DATA}/documents.parquet"))


def rows_of(df):
    return sorted(json.dumps(r.asDict(), sort_keys=True, default=str) for r in df.collect())


@pytest.fixture(scope="module")
def stages(spark):
    """The documents that each stage gets, and its result."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = common.written(stage(spark, docs, DATA), name)
        out.append((docs, result))
        docs = result
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    columns = stages[0][0].columns
    assert all(r.columns == columns for _, r in stages[:-1]) and stages[-1][1].columns != columns


def test_toxicity_stage(spark, stages):
    docs, out = stages[0]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    fitted = toxicity.fit(docs, labels)
    want = [r for r in docs.collect() if fitted.scorer.score(r.text)[0] < fitted.threshold]
    assert rows_of(out) == sorted(json.dumps(r.asDict(), sort_keys=True, default=str) for r in want) and len(want) < docs.count()
    assert toxic_documents(docs, labels).count() == docs.count() - len(want)


def test_line_stage(stages):
    docs, out = stages[1]
    bits = line_bits(docs)
    want = set()
    for (doc_id, _), (text, keep) in bits.items():
        new = "\n".join(x for x, k in zip(text.split("\n"), keep) if k)
        if new.strip() or not text.strip():
            want.add((doc_id, new, len(new)))
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == want


def test_near_copies_stage(stages):
    docs, out = stages[2]
    gone = set()
    for g in near_brute(docs):
        members = sorted((d for d, _, _ in g), key=lambda d: (d is not None, d or 0))
        gone |= set(members[1:])
    assert rows_of(out) == rows_of(docs.where(~F.col("doc_id").isin(sorted(gone)))) if gone else rows_of(docs)


def test_decontamination_stage(spark, stages):
    docs, out = stages[3]
    grams = {}
    for (item,) in spark.read.parquet(f"{DATA}/benchmark.parquet").select("text").collect():
        w = [x[2] for x in words(item)]
        n = min(8, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            grams.setdefault(n, set()).add(tuple(w[j : j + n]))
    want = {}
    for r in docs.collect():
        w, hit = words(r.text), set()
        for n, known in grams.items():
            for j in range(len(w) - n + 1):
                if tuple(x[2] for x in w[j : j + n]) in known:
                    hit |= set(range(j, j + n))
        if hit and len(hit) / len(w) >= 0.5:
            continue
        text = r.text
        for p in sorted(hit, reverse=True):
            end = w[p + 1][0] if p + 1 in hit else w[p][1]
            text = text[: w[p][0]] + text[end:]
        want[r.doc_id] = text
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_packing_stage(stages):
    docs, out = stages[4]
    assert windows(out) == packed(docs, 2048)


def test_run_is_the_stages_one_after_another(spark, stages):
    assert rows_of(corpus_pipeline.run(spark, DATA)) == rows_of(stages[-1][1])


def test_stages_take_messy_and_empty_tables(spark, messy, empty, nulls, tmp_path):
    for name, rows in (("labels", spark.createDataFrame([], "doc_id bigint, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id bigint, text string"))):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    for docs in (messy, empty, nulls):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= docs.count()
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 0


def test_shards_cover_whatever_the_flat_size(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    key = lambda: sorted(map(str, near_groups(docs).collect()))
    whole = key()
    monkeypatch.setattr(simhash, "FLAT", 1)
    assert key() == whole
