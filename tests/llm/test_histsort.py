from __future__ import annotations

from pyspark.sql import functions as F

from sluicebox.llm.histsort import hash_key, histogram_sort, splitters


def least_keys(sized, shards):
    total, out = sum(w for _, w in sized), []
    keys = sorted({k for k, _ in sized})
    for i in range(1, shards):
        below = [(k, sum(w for x, w in sized if x < k)) for k in [*keys, keys[-1] + 1]]
        out.append(next(k for k, b in below if b * shards >= i * total))
    return out


def shard(bounds, k):
    return sum(b <= k for b in bounds)


def test_splitters_are_exact(spark):
    sized = [((i * i * 37) % 1009, 1 + (i % 7) ** 3) for i in range(300)] + [(500, 5000)]
    df = spark.createDataFrame(sized, "k bigint, w bigint").repartition(5)
    bounds, total, rounds = splitters(df, 6, probes=4)
    want = least_keys(sized, 6)
    assert total == sum(w for _, w in sized) and rounds > 1
    assert [sum(w for k, w in sized if k < b) for b in bounds] == [sum(w for k, w in sized if k < b) for b in want]


def test_tolerance_is_met_in_fewer_rounds(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.lit(1).cast("bigint").alias("w"))
    bounds, total, rounds = splitters(df, 4, tolerance=0.1, probes=4)
    assert all(0 <= b - (i + 1) * total / 4 <= 0.1 * total / 4 for i, b in enumerate(bounds))
    assert rounds <= splitters(df, 4, probes=4)[2]


def test_all_rows_move_once_to_their_shard(spark, messy):
    out = histogram_sort(messy, F.col("doc_id"), shards=4)
    assert out.columns == [*messy.columns, "shard_key", "_shard"]
    got = out.withColumn("part", F.spark_partition_id()).collect()
    assert all(r["part"] == r["_shard"] for r in got)
    assert sorted(str(tuple(r)[: len(messy.columns)]) for r in got) == sorted(str(tuple(r)) for r in messy.collect())
    sized = [(r["shard_key"], len((r["text"] or "").encode()) + 1) for r in got]
    bounds = least_keys(sized, 4)
    assert all(shard(bounds, r["shard_key"]) == r["_shard"] for r in got)
    for p in range(4):
        keys = [r["shard_key"] for r in got if r["part"] == p]
        assert keys == sorted(keys)


def test_the_greatest_and_the_least_key(spark):
    top, low = 2**63 - 1, -(2**63)
    docs = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate([top] * 5 + [low] * 3 + [0, 1, None])], "doc_id bigint, text string")
    got = histogram_sort(docs, F.col("doc_id"), shards=4).collect()
    bounds = least_keys([(r.shard_key, len(r.text) + 1) for r in got], 4)
    assert len(got) == 11 and all(shard(bounds, r.shard_key) == r.shard for r in got)


def test_empty_and_null_tables(spark, empty, nulls):
    assert histogram_sort(empty, hash_key("doc_id")).collect() == []
    assert len(histogram_sort(nulls, F.col("doc_id"), shards=3).collect()) == 3
