from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicebox.operators.dedup import CHECKS, duplicate_policy, jaccard_pairs, signs_of
from sluicebox.operators.verify import duplicate_decisions, duplicate_summary

SCHEMA = "ord bigint, exact string, tree string, bucket string, items array<string>, pinned boolean, name string"


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def walk(rows, threshold):
    """One row after another, as the policy says."""
    out, kept = {}, []
    for r in sorted(rows, key=lambda r: (not r[5], r[0])):
        ord_, exact, tree, bucket, items, pinned, name = r
        hit = None
        if not pinned:
            for check, test in zip(CHECKS, (lambda k: exact is not None and k[1] == exact, lambda k: tree is not None and k[2] == tree, None)):
                if test is not None:
                    found = [k for k in kept if test(k)]
                    hit = (check, found[0][0], None) if found else None
                else:
                    near = [k for k in kept if k[3] == bucket and jaccard(set(items), set(k[4])) >= threshold]
                    if near:
                        best = min(near, key=lambda k: k[6])
                        hit = (check, best[0], jaccard(set(items), set(best[4])))
                if hit:
                    break
        if hit is None:
            kept.append(r)
        out[ord_] = (hit is None, *(hit or (None, None, None)))
    return out


def made(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(70):
        k = rng.randint(0, 14)
        items = sorted({f"i{k}_{j}" for j in range(10)} - {f"i{k}_{rng.randint(0, 14)}" for _ in range(rng.randint(0, 2))})
        body = (tuple(items), rng.randint(0, 1))
        rows.append((i * 7 % 71, f"e{hash(body) % 10**9}", rng.choice([None, f"t{rng.randint(0, 25)}"]) if rng.random() < 0.4 else f"t{hash(items[0]) % 997}", rng.choice(["x", "y"]), items, rng.random() < 0.1, f"n{rng.randint(0, 10**6):07d}"))
    rows.append((900, None, None, "x", [], False, "z"))
    rows.append((901, None, None, "x", [], False, "z"))
    return rows


@pytest.mark.parametrize("seed", range(5))
def test_decisions_equal_the_walk(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.ord: (r.accepted, r.check, r.matched, r.similarity) for r in duplicate_policy(df, "exact", "tree", "bucket", "items", 0.6, "pinned", "name").collect()}
    assert got == walk(rows, 0.6)


def test_a_hot_copy_makes_no_pairs(spark):
    rows = [(i, "same", "same", "b", ["a", "b", "c"], False, str(i)) for i in range(3000)] + [(5000, "o", "o", "b", ["q"], False, "o")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = duplicate_policy(df, "exact", "tree", "bucket", "items").collect()
    assert {r.ord for r in got if r.accepted} == {0, 5000} and {(r.check, r.matched) for r in got if not r.accepted} == {("exact_code_pair", 0)}


def test_empty_and_null_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert duplicate_policy(none, "exact", "tree", "bucket", "items").collect() == []
    nulls = spark.createDataFrame([(i, None, None, None, None, None, None) for i in range(3)], SCHEMA)
    assert all(r.accepted for r in duplicate_policy(nulls, "exact", "tree", "bucket", "items", pinned="pinned").collect())


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_pairs_equal_all_pairs(spark, threshold):
    rng = random.Random(11)
    rows = [(i, rng.choice("ab"), sorted({f"s{rng.randint(0, 12)}" for _ in range(rng.randint(0, 9))})) for i in range(80)]
    df = spark.createDataFrame(rows, "ord bigint, b string, s array<string>")
    got = {(r.ord, r.earlier): r.similarity for r in jaccard_pairs(df, "b", "s", threshold).collect()}
    want = {(x[0], y[0]): jaccard(set(x[2]), set(y[2])) for x in rows for y in rows if y[0] < x[0] and x[1] == y[1] and jaccard(set(x[2]), set(y[2])) >= threshold}
    assert got == want


RECORD = "ord bigint, id string, cwe string, mode string, vulnerable_code string, fixed_code string"


def simple(name, total, n):
    return f"def f({name}):\n    {total} = {name} + {n}\n    return {total}\n", f"def f({name}):\n    {total} = int({name}) + {n}\n    return {total}\n"


def long(extra):
    signs = ["+", "-", "*", "/", "//", "%", "|", "&"]
    body = "".join(f"    s{i} = value {signs[i % 8]} {i} {signs[i // 8 % 8]} s {signs[i // 10]} 1\n" for i in range(80))
    return f"def g(value):\n{body}{extra}    return value\n", f"def g(value):\n{body}{extra}    return abs(value)\n"


def test_the_five_record_sequence(spark):
    rows = [(0, "s1", "CWE-89", "sql", *simple("name", "total", 1)), (1, "s2", "CWE-89", "sql", *simple("name", "total", 1)), (2, "s3", "CWE-78", "command_injection", *simple("user", "score", 99)), (3, "s4", "CWE-89", "sql", *long("")), (4, "s5", "CWE-89", "sql", *long("    marker = step_17\n")), (5, "s6", "CWE-78", "command_injection", *long("    marker = step_17\n"))]
    found = duplicate_decisions(spark.createDataFrame(rows, RECORD))
    got = {r.ord: (r.check, r.matched) for r in found.collect()}
    assert got == {0: (None, None), 1: ("exact_code_pair", 0), 2: ("normalized_ast", 0), 3: (None, None), 4: ("near_duplicate", 3), 5: (None, None)}
    assert min(r.similarity for r in found.where("ord = 4").collect()) >= 0.9
    assert {r.key: r.value for r in duplicate_summary(found.where("ord < 5")).collect()} == {"checked": 5, "exact_code_pair": 1, "normalized_ast": 1, "near_duplicate": 1}


def test_seeded_rows_take_part_unseen(spark):
    rows = [(10, "old", "CWE-89", "sql", *simple("a", "b", 1), True), (11, "old2", "CWE-89", "sql", *simple("a", "b", 1), True), (1, "new", "CWE-89", "sql", *simple("a", "b", 1), False)]
    got = {r.ord: (r.accepted, r.matched) for r in duplicate_decisions(spark.createDataFrame(rows, RECORD + ", pinned boolean"), "pinned").collect()}
    assert got == {10: (True, None), 11: (True, None), 1: (False, 10)}


@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_similar_sets_share_a_sign_and_differ_in_few_bits(threshold):
    rng = random.Random(3)
    fresh = lambda k: [rng.getrandbits(64) - 2**63 for _ in range(k)]
    for n in (1, 2, 9, 10, 19, 57, 256, 257, 900):
        for _ in range(40):
            own = fresh(n)
            other = own[: rng.randint(int(n * threshold), n)] + fresh(rng.randint(0, n // 10))
            if not other or jaccard(set(own), set(other)) < threshold:
                continue
            counts, keys, sketch, wide = signs_of(np.array([n, len(other)]), np.array(own + other), threshold)
            assert set(keys[: counts[0]]) & set(keys[counts[0] :])
            apart = len(set(own) ^ set(other))
            assert max(n, len(other)) > 256 or bin(int(sketch[0] ^ sketch[1]) & (1 << 64) - 1).count("1") <= apart
            assert min(n, len(other)) <= 256 or sum(bin(int(x) & (1 << 64) - 1).count("1") for x in wide[:32] ^ wide[32:]) <= apart


def test_pairs_write_no_items_of_sets_without_a_candidate(spark):
    """The tables and exchanges of the pairs follow the parts of the sets, not their items."""
    items = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.sha2(F.concat_ws("-", "ord", i), 256))
    rows = spark.range(300).select(F.col("id").alias("ord"), F.lit("x").alias("bucket"), F.when(F.col("id") == 7, F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.sha2(F.concat_ws("-", F.lit(8), i), 256))).otherwise(items).alias("items"))
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    assert [tuple(r) for r in jaccard_pairs(rows, "bucket", "items").collect()] == [(8, 7, 1.0)]
    assert sum(p.stat().st_size for p in folder.rglob("*.parquet")) - before < 0.2 * 300 * 300 * 64


def test_signs_that_go_on_over_batches(spark):
    """All pairs of a cluster of different sets, in batches of a few rows."""
    rows = [(i, "x", [f"i{j}" for j in range(40)] + [f"o{i}"]) for i in range(30)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.ord, r.earlier): r.similarity for r in jaccard_pairs(spark.createDataFrame(rows, "ord bigint, bucket string, items array<string>"), "bucket", "items").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {(i, j): 40 / 42 for i in range(30) for j in range(i)}
