from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sluicebox.llm.common import digest
from sluicebox.llm.packing import cuts, pack
from sluicebox.llm.tokenizers import DEFAULT_PATH, encoding, load_ranks


def brute(docs, window):
    ranks = load_ranks(DEFAULT_PATH)
    codec = encoding(ranks)
    stream = []
    rows = docs.select("doc_id", digest().alias("g"), "text").where("text <> ''").collect()
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.g)):
        ids = [*codec.encode_ordinary(r.text), len(ranks)]
        stream += [(r.doc_id, i, t) for i, t in enumerate(ids)]
    out = {}
    for w in range(0, len(stream), window):
        part, segs = stream[w : w + window], []
        for d, i, _ in part:
            if segs and segs[-1][0] == d and segs[-1][2] == i:
                segs[-1][2] = i + 1
            else:
                segs.append([d, i, i + 1])
        out[w // window] = ([t for *_, t in part], segs)
    return out


def got(df):
    rows = df.collect()
    out = {r.window_id: (r.tokens, [list(x) for x in zip(r.doc_ids, r.starts, r.ends)]) for r in rows}
    assert len(out) == len(rows) and all(r.n_tokens == len(r.tokens) for r in rows)
    return out


@pytest.mark.parametrize(("window", "bucket"), [(64, 1000), (2048, 5000), (700, 300), (64, 10**6)])
def test_windows_equal_concatenation(messy, window, bucket):
    assert got(pack(messy, window, bucket_tokens=bucket)) == brute(messy, window)


def test_only_the_last_window_is_short(messy):
    rows = sorted(pack(messy, 128, bucket_tokens=500).collect(), key=lambda r: r.window_id)
    assert [r.window_id for r in rows] == list(range(len(rows)))
    assert all(r.n_tokens == 128 for r in rows[:-1])


def test_a_document_longer_than_a_bucket_and_ties(spark):
    docs = spark.createDataFrame([(1, "word " * 900), (1, "word " * 900), (1, "other"), (2, "x")], "doc_id bigint, text string")
    assert got(pack(docs, 50, bucket_tokens=100)) == brute(docs, 50)


@pytest.mark.parametrize("hot", [None, 7, 2**63 - 1, -(2**63)])
def test_an_id_heavier_than_buckets_is_cut_within(spark, hot):
    rows = [(hot, f"text number {i} of the same id") for i in range(60)] + [(hot, "again and again the same row")] * 50 + [(i, f"row {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).cache()
    out = pack(docs, 32, bucket_tokens=100)
    assert got(out) == brute(docs, 32)
    coded = docs.select("doc_id", digest().alias("digest"), F.length("text").cast("bigint").alias("n"), F.xxhash64(F.monotonically_increasing_id()).alias("row"))
    found = cuts(coded, F.coalesce("doc_id", F.lit(-(2**63))), 12, 300)
    sizes = Counter()
    for r in coded.collect():
        k = -(2**63) if r.doc_id is None else r.doc_id
        sizes[bisect_right(found, (k, r.doc_id is not None, r.digest, r.row))] += r.n
    assert max(sizes.values()) < 900 < sum(sizes.values()) / 3


def test_no_tokens_no_windows(spark, empty, nulls):
    assert pack(empty).collect() == pack(nulls).collect() == []
    assert pack(spark.createDataFrame([(1, "")], "doc_id bigint, text string")).agg(F.count("*")).first()[0] == 0
