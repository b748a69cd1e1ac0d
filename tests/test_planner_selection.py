from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sluicebox.functions import prompts
from sluicebox.functions.registry import FIELDS, FLOWS_OF, MODES, compatible
from sluicebox.operators import coverage, planner, release, selection

RECORD = "mode string, application_type string, flow_pattern string, structure string, difficulty string, sample_index int"
LOG = "id string, cwe string, mode string, generation_profile string, context struct<cwe_key:string,cwe:string,mode:string,application_type:string,flow_pattern:string,structure:string,difficulty:string,sample_index:int,generation_profile:string>"


def sql(i, **more):
    return ("sql", "Flask", "direct", "single_function", "easy", i)


def plan(spark, rows, n, modes=("sql",), profile="compact"):
    return planner.plan(spark.createDataFrame(rows, RECORD), n, list(modes), profile).collect()


def test_new_slots_are_level_and_possible(spark):
    got = plan(spark, [], 12)
    assert [tuple(r) for r in got] == [tuple(r) for r in plan(spark, [], 12)]
    for f in FIELDS:
        n = Counter(r[f] for r in got).values()
        assert max(n) - min(n) <= 1
    assert sorted(r.sample_index for r in got) == list(range(12)) and [r.plan_order for r in got] == sorted(r.plan_order for r in got)
    whole = plan(spark, [], 72)
    assert len({tuple(r[f] for f in FIELDS) for r in whole}) == 72 and all(r.flow_pattern in FLOWS_OF[r.structure] for r in whole)
    assert len(compatible("sql")) == 72 and "single_function" not in {r.structure for r in plan(spark, [], 12, profile="window_balanced")}


def test_existing_records_steer_and_count(spark):
    (one,) = plan(spark, [sql(i) for i in range(5)], 6)
    assert one.application_type != "Flask" and one.flow_pattern != "direct" and one.sample_index == 5
    assert len(plan(spark, [sql(0), sql(1)], 3)) == 1 and plan(spark, [sql(0), sql(1)], 2) == [] == plan(spark, [], 3, ["odd"])
    with pytest.raises(ValueError):
        plan(spark, [], -1)


def test_what_a_log_counts(spark):
    c = lambda **k: (k.get("key"), k.get("cwe"), k.get("mode"), "Flask", "direct", "single_function", "easy", 3, k.get("profile"))
    rows = [("a", None, None, None, c(key="sql")), ("b", "cwe-89", "XSS", None, c()), ("c", None, "sql", "window_balanced", c()), ("d", None, "sql", None, c(profile="window_balanced")), ("e", None, "sql", "odd", c()), ("f", None, "sql", None, None), ("g", None, "zzz", None, c())]
    log = spark.createDataFrame(rows, LOG)
    assert sorted((r.mode, r.application_type) for r in planner.records_of(log).collect() if r.application_type) == [("sql", "Flask")] * 3 + [("xss", "Flask")]
    assert planner.records_of(log).count() == 5 and planner.records_of(log, "window_balanced").count() == 2
    assert planner.wanted_modes(["CWE-79 ", "zzz"]) == ["xss"] and planner.wanted_modes(["zzz"]) == [] and planner.wanted_modes(None) == MODES


def test_summary_of_a_plan(spark):
    have = spark.createDataFrame([sql(0), sql(1)], RECORD)
    planned = planner.plan(have, 3, ["sql"])
    none = planned.where("false")
    row = {r.mode: r for r in coverage.plan_summary(have, planned, none).collect()}
    assert (row["sql"].target, row["sql"].existing, row["sql"].planned, row["sql"].target_met, row["sql"].uncovered_contexts) == (3, 2, 1, False, 71)
    assert "difficulty=hard" in row["sql"].uncovered_values.split(",") and "difficulty=easy" not in row["sql"].uncovered_values.split(",")
    done = {r.mode: r for r in coverage.plan_summary(have, planned, planned).collect()}["sql"]
    assert done.target_met and done.total == 3 and row["xsrf"].target_met and row["xsrf"].uncovered_contexts == 18
    zero = coverage.marginals(planner.existing_counts(have)).where("mode = 'sql' and field = 'structure'").collect()
    assert {r.value: r.n for r in zero} == {"single_function": 2, "class_based": 0, "multi_function": 0}
    assert coverage.performance(spark.createDataFrame([(2, 1), (3, None)], "attempts bigint, accepted_attempt bigint"), 30.0, 2) == {"workers": 2, "attempts": 5, "accepted": 1, "rejected": 4, "elapsed_seconds": 30.0, "accepted_per_minute": 2.0, "attempts_per_minute": 10.0}


def test_next_ids(spark):
    rows = [("CWE-89_sql_000003",), ("CWE-89_sql_draft",), ("other_000999",), ("CWE-89_sql_000002_x",), ("xCWE-89_sql_000500",), (None,), ("CWE-89_sql_12345678901234567890",)]
    df = spark.createDataFrame(rows, "id string")
    one = lambda d, p: d.agg(planner.next_sample_id(F.col("id"), F.lit(p)).alias("n")).first().n
    assert one(df, "CWE-89_sql_") == "CWE-89_sql_12345678901234567891"
    assert one(df.where("length(id) < 20"), "CWE-89_sql_") == "CWE-89_sql_000004"
    assert one(df, "q.") == "q.000001" and planner.round_robin("sql", 73) == compatible("sql")[1]


@pytest.mark.parametrize(("n", "want"), [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (2, 0, 1)), (4, (2, 1, 1)), (90, (62, 14, 14)), (100, (70, 15, 15))])
def test_split_sizes(spark, n, want):
    files = spark.range(n).select(F.lit("m").alias("mode"), F.concat(F.lit("g"), F.col("id")).alias("g"))
    got = Counter(r.split for r in selection.commit_split(files, ["mode"], "g").collect())
    assert tuple(got[s] for s in ("train", "validation", "test")) == want


def rank(g, seed=selection.SEED):
    return hashlib.sha256(f"{seed}|{g}".encode()).hexdigest()


def test_caps_keep_all_files_of_a_commit(spark):
    rows = [("m", f"c{i}", f) for i in range(4) for f in range(1 + (i == 2))]
    got = selection.commit_cap(spark.createDataFrame(rows, "mode string, g string, f int"), "mode", "g", 3).collect()
    kept = sorted((f"c{i}" for i in range(4)), key=rank)[:3]
    assert sorted((r.g, r.f) for r in got) == sorted((g, f) for _, g, f in rows if g in kept)


def greedy(rows, n):
    """The choice one by one: least whole context, then least values in order, then rank."""
    left, out, whole, values = list(rows), [], Counter(), [Counter() for _ in range(4)]
    while len(out) < n and left:
        best = min(left, key=lambda r: (whole[r[1:]], *(values[i][r[1 + i]] for i in range(4)), rank(r[0])))
        left.remove(best)
        out.append(best[0])
        whole[best[1:]] += 1
        for i in range(4):
            values[i][best[1 + i]] += 1
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_balanced_choice_equals_the_greedy_one(spark, seed):
    rng = random.Random(seed)
    rows = [(f"g{i}", *(rng.choice("ab"[: rng.randint(1, 2)]) + f for f in "wxyz")) for i in range(60)]
    df = spark.createDataFrame([("m", *r) for r in rows], "mode string, g string, a string, b string, c string, d string")
    for n in (1, 7, 23, 60, 99):
        got = sorted(r.g for r in selection.balanced_select(df, "mode", ["a", "b", "c", "d"], "g", n).collect())
        assert got == greedy(rows, n)


FILE = "dataset string, mode string, commit_id string, repo string, filename string, source string, fixed_source string, badparts array<string>, goodparts array<string>, context struct<application_type:string,flow_pattern:string,difficulty:string,structure:string>, group_id string"


def files(dataset, per):
    out = []
    for m in MODES:
        for i in range(per):
            ctx = (["Flask", "API"][i % 2], "direct", "easy", "class_based")
            out.append((dataset, m, f"c{i}", "r", "a.py", f"bad{i} = 1\n" + "x = y + 2\n" * (60 * (i % 3)), "", [f"bad{i}"], [], ctx, f"{dataset}:{m}:r:c{i}"))
    return out


def test_a_release_as_a_whole(spark):
    made, real = spark.createDataFrame(files("synthetic", 12), FILE), spark.createDataFrame(files("real", 9), FILE)
    out = release.prepare(made, real, 8)
    per = Counter((r.dataset, r.mode) for r in out.splits.collect())
    assert set(per.values()) == {8} and len(per) == 14
    assert {r.application_type for r in out.synthetic.select("context.application_type").distinct().collect()} == {"Flask", "API"}
    windows = out.windows.collect()
    assert max(Counter((r.group_id, r.label) for r in windows).values()) <= 4 and {r.label for r in windows} == {0, 1}
    again = release.prepare(made.repartition(7), real.repartition(5), 8).windows.collect()
    assert sorted(map(str, windows)) == sorted(map(str, again))
    summary = {(r.section, r.key): r.value for r in release.release_summary(out.synthetic.unionByName(out.real), out.windows).collect()}
    assert summary[("real_commits", "xss")] == 8 and summary[("labels", "positive_windows")] + summary[("labels", "negative_windows")] == len(windows)
    assert out.window_count.first().n >= len(windows) and Counter(r["mode"] for r in out.audit.collect()) == {m: 2 for m in MODES}
    release.assert_slices(out.windows)
    assert release.slice_of(out.windows, "real", "xss", "test").count() == sum(r["dataset"] == "real" and r["mode"] == "xss" and r.split == "test" for r in windows)
    with pytest.raises(ValueError, match="fewer than 13"):
        release.prepare(made, real, 13)
    with pytest.raises(ValueError, match="xss real test"):
        release.assert_slices(out.windows.where("not (mode = 'xss' and dataset = 'real' and split = 'test')"))


def test_window_caps(spark):
    source = "w " * 260
    rows = [("d", "m", "g", "f", source + "bad " + "w " * 300, ["bad"])]
    df = spark.createDataFrame(rows, "dataset string, mode string, group_id string, filename string, source string, badparts array<string>")
    got = release.windows_of(df, 3, 3).collect()
    assert Counter(r.label for r in got) == {1: 3, 0: 3}
    key = lambda r: hashlib.sha256(f"{selection.SEED}|g|f|{r.label}|{' '.join(r.tokens)}".encode()).hexdigest()
    every = release.windows_of(df, 999, 999).collect()
    for y in (0, 1):
        want = sorted((key(r), r.start) for r in every if r.label == y)[:3]
        assert sorted((key(r), r.start) for r in got if r.label == y) == want


def test_prompts(spark):
    df = spark.createDataFrame([("xss", "Flask", "direct", "single_function", "easy", i) for i in range(5)] + [("sql", "Django", "complex", "multi_function", "hard", 0), ("xss", "CLI", "direct", "class_based", "easy", 1)], RECORD)
    p = [r.p for r in df.select(prompts.prompt(*map(F.col, ("mode", "application_type", "flow_pattern", "structure", "difficulty", "sample_index"))).alias("p")).collect()]
    assert len(set(p[:4])) == 4 and p[0] == p[4] and "HTML" in p[0] and "HTML" not in p[6] and "CWE-89" in p[5] and "%s" in p[5]
