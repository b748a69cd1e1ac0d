"""What keeps the work of one task from following a mode, a class or a window."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sluicebox.functions import text
from sluicebox.functions.registry import MODES
from sluicebox.operators import candidates, export, release, reports

SPACED = [" a ", "\t\x1c a　b  ", "\x85\xa0 x\r\n", "", "  ", "​z᠎", "a b", "\x1fq\x00 "]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_row_index_puts_only_keys_in_order(spark):
    rows = [(m, o, f"t{i}") for i, (m, o) in enumerate([("a", 3), ("a", 1), (None, 5), ("b", 2), (None, 4), ("a", 2), ("b", None)])]
    df = spark.createDataFrame(rows, "mode string, ord bigint, text string").repartition(3)
    out = reports.row_index(df, "mode", "ord")
    assert {(r.mode, r.ord): r.row_index for r in out.collect()} == {("a", 1): 1, ("a", 2): 2, ("a", 3): 3, (None, 4): 1, (None, 5): 2, ("b", None): 1, ("b", 2): 2}
    assert not re.search(r"Window \[", plan(out).split("Join")[0]) and "row_number" not in plan(out)
    twice = reports.row_index(df.unionByName(df), "mode", "ord")
    assert sorted((r.mode or "", r.row_index) for r in twice.collect()) == [("", 1), ("", 2), ("", 3), ("", 4), *[("a", i) for i in range(1, 7)], *[("b", i) for i in range(1, 5)]]


def test_overwritten_records_are_found_without_the_texts(spark):
    cols = "mode string, row_index int, ord bigint, id string, commit_message string, filename string, vulnerable_code string, fixed_code string, diff string, badparts array<string>, goodparts array<string>"
    rows = [("a", i + 1, i, x, "m", "f.py", f"v{i}", f"w{i}", "", [], []) for i, x in enumerate(["x", None, "x", "y", None, "x"])]
    flat = export.flat_commits(spark.createDataFrame(rows, cols))
    assert {(r.commit_id, r.before) for r in flat.collect()} == {("x", "v5\n"), ("sample_000002", "v1\n"), ("y", "v3\n"), ("sample_000005", "v4\n")}
    assert "max_by" not in plan(flat)
    tied = export.flat_commits(spark.createDataFrame([*rows, ("a", 7, 5, "x", "m", "f.py", "v6", "w6", "", [], [])], cols))
    assert sorted(r.commit_id for r in tied.collect()) == ["sample_000002", "sample_000005", "x", "y"]


def test_strip_takes_the_same_characters_as_the_pattern(spark):
    df = spark.createDataFrame([(x,) for x in SPACED], "x string")
    old = F.regexp_replace("x", f"(?U)^{text.SPACE}|{text.SPACE}$", "")
    assert all(r.a == r.b for r in df.select(text.strip(F.col("x")).alias("a"), old.alias("b")).collect())
    assert "regexp" not in plan(df.select(text.strip(F.col("x"))))


def test_window_texts_are_the_joined_windows(spark):
    for n, window, stride in [(0, 200, 5), (1, 200, 5), (199, 200, 5), (200, 200, 5), (203, 200, 5), (417, 200, 5), (31, 7, 3), (30, 8, 4)]:
        t = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")) if n else F.array().cast("array<string>")
        want = F.transform(text.window_starts(F.size(t), window, stride), lambda s: F.array_join(F.slice(t, s + 1, window), " "))
        r = spark.range(1).select(text.window_texts(t, window, stride).alias("a"), want.alias("b")).first()
        assert r.a == r.b


def test_capped_windows_carry_no_tokens_while_they_are_ranked(spark):
    df = spark.createDataFrame([("real", "m", "g", "f", " ".join(f"w{i}" for i in range(260)), ["w7 w8"])], "dataset string, mode string, group_id string, filename string, source string, badparts array<string>")
    out = release.windows_of(df)
    rows = out.collect()
    assert len(rows) == 6 and all(r.tokens == [f"w{i}" for i in range(r.start, r.start + 200)] and r.label == (r.start <= 8) and r.n_windows == 13 for r in rows if r.start <= 8 or r.label == 0) and {r.n_windows for r in rows} == {13}


def test_marked_lines_make_the_lines_once(spark):
    code = "x = 1\n cursor.execute('SELECT') \n\nredirect(a)\nfrom b import redirect(\nmethods=['POST']\nsubprocess.run([c])\nESCAPE(d)\nallowed = 1"
    df = spark.createDataFrame([(m, code) for m in [*MODES, "odd"]], "mode string, code string")
    c, low = text.lines(F.col("code")), F.transform(text.lines(F.col("code")), F.lower)
    out = df.select("mode", candidates.vulnerable_lines(F.col("mode"), F.col("code")).alias("a"), candidates.vulnerable_of(F.col("mode"), c, low).alias("b"), candidates.fixed_lines(F.col("mode"), F.col("code")).alias("x"), candidates.fixed_of(F.col("mode"), c, low).alias("y"))
    got = {r.mode: r for r in out.collect()}
    assert all(r.a == r.b and r.x == r.y for r in got.values())
    assert got["sql"].a == ["cursor.execute('SELECT')"] and got["open_redirect"].a == ["redirect(a)"] and got["xsrf"].a == ["methods=['POST']"] and got["odd"].a == []
    assert got["command_injection"].x == ["subprocess.run([c])"] and got["xss"].x == ["ESCAPE(d)"] and got["open_redirect"].x == ["allowed = 1"]
    assert plan(df.select(candidates.vulnerable_lines(F.col("mode"), F.col("code")).alias("o"))).count("split(") == 1
