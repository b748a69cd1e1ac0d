from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sluicebox.functions import pycode, safe, text

TOKEN = re.compile(r"[A-Za-z_]\w*|\d+(?:\.\d+)?|==|!=|<=|>=|//|<<|>>|\*\*|[^\s]")
ODD = ["a\x1cb", "e\u0301te\u0301 caf\u00e9", "x\u00b2 + y\u2082", "a\u3000b\u00a0c\x85d", "\u0661\u0662\u0663.5 1.5.2 1..2", "a==b!=c<=d>=e//f<<g>>h**i = =", "", " \t\n", "_x9 9x", "\u0416\u0437 \u65e5\u672c\u8a9e", "\U0001f642\U0001f642", "a\u200bb\u2028c", "\u00bd \u2167 \u0bf0"]


def table(spark, values, schema="t string"):
    return spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)


def test_tokens_are_those_of_the_rule(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice("ab_1 .=!<>/*\n\t\u00e9\u0301\u00b2\u3000\x1d#") for _ in range(60)) for _ in range(200)]
    got = table(spark, ODD + made).select("t", text.tokens(F.col("t")).alias("x")).collect()
    assert all(r.x == TOKEN.findall(r.t) for r in got)


def test_tokens_of_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", text.tokens(F.col("text")).alias("x")).collect()
    assert all(r.x == TOKEN.findall(r.text) for r in docs)
    assert TOKEN.findall("value = user_input + 1") == ["value", "=", "user_input", "+", "1"]


def test_strip_and_lines_are_those_of_strings(spark):
    values = ["\x1c a \x85", "\u3000x\u2009", "a\r\nb\rc\x0bd\x1ee\u2028f\n\n", "", "  ", "\u200bx\u200b"]
    for r in table(spark, values).select("t", text.strip(F.col("t")).alias("s"), text.lines(F.col("t")).alias("l")).collect():
        assert r.s == r.t.strip() and r.l == [x.strip() for x in r.t.splitlines() if x.strip()]


def spans(source, parts):
    out = []
    for p in parts:
        at = source.find(p) if p else -1
        while at >= 0:
            out.append((at, at + len(p)))
            at = source.find(p, at + len(p))
    return out


def starts(n, window, stride):
    if n <= 0:
        return []
    s = list(range(0, max(1, n - window + 1), stride))
    return s if max(0, n - window) in s else [*s, max(0, n - window)]


def labels(source, parts, window, stride):
    ms, sp = list(TOKEN.finditer(source)), spans(source, parts)
    return [int(any(ms[s].start() < b and a < ms[min(s + window, len(ms)) - 1].end() for a, b in sp)) for s in starts(len(ms), window, stride)]


def test_windows_equal_a_walk_over_the_tokens(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        source = " ".join(rng.choice(["ab", "x.y", "aa", "=", "\u00e9\\E", "\\Q", "1.5"]) for _ in range(rng.randint(0, 90)))
        rows.append((source, [rng.choice(["aa", "ab x", "", "\\E", "aaa", "nothing", "= ="]) for _ in range(rng.randint(0, 3))]))
    df = spark.createDataFrame(rows, "t string, p array<string>")
    c, p = F.col("t"), F.col("p")
    got = df.select("t", "p", text.part_spans(c, p).alias("s"), text.window_labels(c, p, 10, 3).alias("y"), text.part_token_count(c, p).alias("n"), text.token_windows(c, text.window_labels(c, p, 10, 3), 10, 3).alias("w")).collect()
    for r in got:
        ms, sp = list(TOKEN.finditer(r.t)), spans(r.t, r.p)
        assert [(x.a, x.b) for x in r.s] == sp
        assert r.y == labels(r.t, r.p, 10, 3)
        assert r.n == sum(any(m.start() < b and a < m.end() for a, b in sp) for m in ms)
        assert [(x.start, x.tokens) for x in r.w] == [(s, [m[0] for m in ms[s : s + 10]]) for s in starts(len(ms), 10, 3)]


def test_many_occurrences_in_one_text(spark):
    source = "ab " * 3000
    (r,) = table(spark, [source]).select(text.part_spans(F.col("t"), F.array(F.lit("ab"), F.lit("b a"))).alias("s")).collect()
    assert [(x.a, x.b) for x in r.s] == spans(source, ["ab", "b a"])


@pytest.mark.parametrize(("n", "want"), [(0, []), (1, [0]), (200, [0]), (201, [0, 1]), (206, [0, 5, 6]), (210, [0, 5, 10])])
def test_window_starts(spark, n, want):
    assert spark.range(1).select(text.window_starts(F.lit(n)).alias("s")).first().s == want


def test_short_source_has_one_window_and_its_label(spark):
    rows = [("a b", ["a"]), ("a b", ["q"])]
    got = spark.createDataFrame(rows, "t string, p array<string>").select(text.window_labels(F.col("t"), F.col("p")).alias("y")).collect()
    assert [r.y for r in got] == [[1], [0]]


def test_changed_parts_and_diff(spark):
    before, after = "a = 1\nb = 2\nc = 3\n", "a = 1\nb = 9\nc = 3\nd = 4\n"
    df = spark.createDataFrame([(before, after), (before, before)], "b string, a string").withColumn("d", pycode.unified_diff(F.col("b"), F.col("a"), F.lit("f.py")))
    r, same = df.select("d", text.changed_parts(F.col("d"), "-").alias("bad"), text.changed_parts(F.col("d"), "+").alias("good")).collect()
    assert r.d.startswith("--- a/f.py\n+++ b/f.py\n@@") and r.bad == ["b = 2"] and r.good == ["b = 9", "d = 4"]
    assert same.d == "\n" and same.bad == same.good == []
    odd = table(spark, ["--x\n---y\n-  \n-z\n-z\n+q\r\n++r"]).select(text.changed_parts(F.col("t"), "-").alias("bad"), text.changed_parts(F.col("t"), "+").alias("good")).first()
    assert odd.bad == ["-x", "z"] and odd.good == ["q", "+r"]


def test_python_tokens_and_trees(spark):
    codes = ["x = 1  # note\nfor y in z:\n    pass\n", "x = (", "'a' + \"b\"", "", None, "(" * 500]
    got = table(spark, codes).select("t", pycode.code_tokens(F.col("t")).alias("k"), pycode.tree_fingerprint(F.col("t")).alias("f")).collect()
    assert got[0].k == ["NAME", "=", "NUMBER", "for", "NAME", "in", "NAME", ":", "pass"] and got[2].k == ["STRING", "+", "STRING"]
    a, b, c, d = (pycode.tree_print(x) for x in ("def f(a):\n    return a + 1", "def g(b):\n    return b + 22", "def f(a):\n    return a - 1", "def f(a):\r\n    return ("))
    assert a == b != c != d and d == pycode.tree_print("def f(a):\n    return (\n")
    assert len({r.f for r in got}) == 5  # null and empty are the same


def test_shingles_of_pairs(spark):
    df = spark.createDataFrame([(["a", "b"], ["c", "d", "e"]), ([], ["c"])], "x array<string>, y array<string>")
    got = [r.s for r in df.select(text.shingles(text.pair_tokens(F.col("x"), F.col("y"))).alias("s")).collect()]
    assert got == [["a b <FIXED> c d", "b <FIXED> c d e"], ["<FIXED> c"]]


@pytest.mark.parametrize(("value", "want"), [(" a.b:c-1_ ", "a.b:c-1_"), ("", "unknown"), (None, "unknown"), ("a b", "unknown"), ("\u00e9", "unknown"), ("0", "0"), ("a\n", "a"), ("a\nb", "unknown")])
def test_safe_values(spark, value, want):
    assert table(spark, [value]).select(safe.safe_value(F.col("t")).alias("v")).first().v == want


def test_zero_and_false_are_no_values(spark):
    df = spark.createDataFrame([(0, 0.0, False), (3, 0.5, True)], "i int, d double, b boolean")
    a, b = df.select(*[safe.safe_value(F.col(c)).alias(c) for c in df.columns]).collect()
    assert tuple(a) == ("unknown",) * 3 and tuple(b) == ("3", "0.5", "true")


@pytest.mark.parametrize(("value", "want"), [("a\\b.py", "a/b.py"), ("/x/y.py", "y.py"), ("C:/x/y.py", "y.py"), ("C:\\x.py", "x.py"), ("C:a/b.py", "C:a/b.py"), ("../y.py", "y.py"), ("a/..", ".."), ("", "app.py"), (None, "app.py"), ("/", "app.py"), ("  ", "app.py")])
def test_relative_file_names(spark, value, want):
    assert table(spark, [value]).select(safe.relative_filename(F.col("t")).alias("v")).first().v == want


@pytest.mark.parametrize("value", ["my api_key", "API-key", "Bearer x", "https://a", "C:/x", "/home/x", "a/tmp", "Users\\x"])
def test_unsafe_texts_are_null(spark, value):
    assert table(spark, [value]).select(safe.safe_text(F.col("t")).alias("v")).first().v is None


def test_numbers(spark):
    df = table(spark, ["5", "-1", "x", None, "2.5", "0.0078125", "1e400"])
    got = df.select(safe.safe_integer(F.col("t")).alias("i"), safe.safe_float(F.col("t")).alias("f")).collect()
    assert [r.i for r in got][:4] == [5, None, None, None] and [r.f for r in got] == [5.0, None, None, None, 2.5, 0.007812, None]


def test_rounding_is_that_of_the_binary_value(spark):
    df = spark.range(1, 400).select((F.lit(1.0) / F.col("id")).alias("x"))
    assert all(r.y == round(r.x, 6) for r in df.select("x", pycode.round_binary(F.col("x")).alias("y")).collect())


def test_rule_ids(spark):
    df = table(spark, ["a.rules.x", "a.rules.b.rules.y", "rules.z", "k.rules.q"])
    assert [r.v for r in df.select(safe.rule_id(F.col("t"), "rules", ["k.rules.q"]).alias("v")).collect()] == ["rules.x", "rules.b.rules.y", "rules.z", "k.rules.q"]


@pytest.mark.parametrize(("reply", "want"), [('```json\n{"a": 1}\n```', '{"a": 1}'), ('x {"a": {"b": 2}} y', '{"a": {"b": 2}}'), ("no", None), ("{broken", None), ('{"a": 1} and more', '{"a": 1}'), ('[{"a": 1}]', '[{"a": 1}]'), (None, None)])
def test_json_in_replies(spark, reply, want):
    assert table(spark, [reply]).select(text.json_object(F.col("t")).alias("v")).first().v == want
