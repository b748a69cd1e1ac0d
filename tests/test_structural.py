from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sluicebox.functions import rules
from sluicebox.functions.rules import code_facts

FACTS = [x.split()[0] for x in rules.FACTS.split(", ")]
FLASK = "import sqlite3\nfrom flask import Flask, request\napp = Flask(__name__)\n"
DIRECT = FLASK + "@app.get('/u')\ndef user():\n    name = request.args.get('n')\n    cursor.execute(f\"SELECT * FROM users WHERE n = '{name}'\")\n"
BOUND = FLASK + "@app.get('/u')\ndef user():\n    name = request.args.get('n')\n    cursor.execute('SELECT * FROM users WHERE n = ?', (name,))\n"
COMPLEX = FLASK + "def build(name):\n    return f\"SELECT * FROM users WHERE n = '{name}'\"\ndef run(query):\n    return cursor.execute(query).fetchall()\n@app.get('/u')\ndef user():\n    return run(build(request.args.get('n')))\n"


def facts(code):
    return dict(zip(FACTS, code_facts(code)))


@pytest.mark.parametrize(
    ("code", "bound", "percent"),
    [
        ("c.execute('SELECT id FROM t WHERE n = :name', {'name': x})", True, False),
        ("q = 'SELECT id FROM t WHERE n = ?'\nc.execute(q, (x,))", True, False),
        ("q = f\"SELECT id FROM t WHERE n = '{x}'\"\nc.execute(q, (x,))", False, False),
        ("def b(x):\n    return 'SELECT id FROM t WHERE n = ?', (x,)\ndef e(q, p):\n    c.execute(q, p)\nq, p = b(x)\ne(q, p)", True, False),
        ("def b():\n    return 'SELECT id FROM t WHERE n = ?'\nc.execute(b(), (x,))", True, False),
        ("def b(x):\n    return f\"SELECT id FROM t WHERE n = '{x}'\", (x,)\nq, p = b(x)\nc.execute(q, p)", False, False),
        ("def b():\n    return 'SELECT id FROM t WHERE n = ?'\ndef e(q, p):\n    c.execute(q, p)\nq = b()\ne(q, (x,))", True, False),
        ("c.execute('SELECT id FROM t WHERE n = ?', [x])", True, False),
        ("c.execute('SELECT id FROM t WHERE n = %s', [x])", True, True),
        ("c.execute('SELECT id FROM t')", False, False),
        ("c.execute('SELECT id FROM t', (x,))", False, False),
    ],
)
def test_bound_parameters(code, bound, percent):
    f = facts(code)
    assert (f["bound_sql"], f["bound_sql_percent"]) == (bound, percent)


@pytest.mark.parametrize(("code", "want"), [("row = c.fetchone()\nx = JsonResponse({'u': row})", True), ("row = c.fetchone()\nx = JsonResponse({'u': list(row) if row else None})", False), ("rows = c.fetchall()\nx = HttpResponse(rows)", True), ("x = HttpResponse('a')", False)])
def test_raw_rows_in_responses(code, want):
    assert facts(code)["raw_rows"] is want


@pytest.mark.parametrize(
    ("code", "want"),
    [
        (DIRECT, (True, False, False)),
        (COMPLEX, (False, False, True)),
        (FLASK + "def helper(n):\n    cursor.execute('SELECT * FROM t WHERE n = ' + n)\ndef user():\n    helper(request.args.get('n'))\n", (False, True, False)),
        (FLASK + "class D:\n    def get(self, n):\n        q = f\"SELECT * FROM t WHERE n = '{n}'\"\n        return c.execute(q)\ndef user():\n    return D().get(request.args.get('n'))\n", (False, True, False)),
        ("x = 1", (False, False, False)),
    ],
)
def test_flows(code, want):
    f = facts(code)
    assert (f["flow_direct"], f["flow_indirect"], f["flow_complex"]) == want


def test_imports_of_names_that_frameworks_lack():
    assert facts("from flask import Flask, ify, request")["unknown_imports"] == ["flask.ify"]
    assert facts("from flask import url_for, abort, send_file\nfrom django.http import HttpRequest, HttpResponseRedirect\nfrom .flask import q\nfrom other import z")["unknown_imports"] == []


@pytest.mark.parametrize("code", [None, "", "def (", "\x00", "(" * 3000])
def test_what_does_not_parse_has_no_property(code):
    f = facts(code)
    assert f["functions"] == 0 and not f["bound_sql"] and f["parses"] is (code in (None, ""))


SAFE = [
    "base = Path('/d').resolve()\nt = (base / n).resolve()\nif not t.is_relative_to(base): raise ValueError",
    "base = Path('/d').resolve()\nt = (base / n).resolve()\ntry:\n    t.relative_to(base)\nexcept ValueError: raise",
    "t = (base / n).resolve()\nif base not in t.parents and t != base: raise ValueError",
    "b = os.path.realpath('/d')\nt = os.path.realpath(os.path.join(b, n))\nif os.path.commonpath([b, t]) != b: raise ValueError",
    "t = safe_join('/d', n)\nif t is None: raise ValueError",
]


def test_path_containment(spark):
    rows = [(c, True) for c in SAFE] + [("t = (base / n).resolve()\nif not str(t).startswith(str(base)): raise ValueError", False), ("t = safe_join('/d', n)", False), ("open(n)", False)]
    got = spark.createDataFrame(rows, "c string, want boolean").select("want", rules.path_containment(F.col("c")).alias("v")).collect()
    assert all(r.v == r.want for r in got)


@pytest.mark.parametrize(
    ("kind", "code", "want"),
    [
        ("Flask", "from flask import Flask\napp.add_url_rule('/s', view_func=V)", True), ("Flask", "import flask", False), ("API", "from fastapi import FastAPI\n@app.get('/x')", True), ("API", "class A: pass", False),
        ("Django", "from django.views import View", True), ("Django", "import django", False), ("CLI", "import argparse", True), ("script", "x = input()", True), ("script", "import flask\nx = input()", False), ("other", "x = input()", False),
    ],
)
def test_application_types(spark, kind, code, want):
    assert spark.range(1).select(rules.application(F.lit(kind), F.lit(code)).alias("v")).first().v is want


@pytest.mark.parametrize("code", ["import operator\nops = {'+': operator.add}\nx = ops[s](a, b)", "dispatch = {}", "ast.literal_eval(x)"])
def test_replacements_of_dynamic_code(spark, code):
    df = spark.createDataFrame([(code,)], "c string").withColumn("f", rules.facts(F.col("c")))
    assert df.select(rules.code_replacement(F.col("c"), F.col("f")).alias("v")).first().v


def reasons(spark, mode, app, flow, shape, before, after):
    df = spark.createDataFrame([(mode, app, flow, shape, before, after)], "mode string, app string, flow string, shape string, b string, a string")
    df = df.withColumn("seen", rules.facts(F.col("b"))).withColumn("fixed", rules.facts(F.col("a")))
    return df.select(rules.structural_reasons(*map(F.col, ("mode", "app", "flow", "shape", "b", "a", "seen", "fixed"))).alias("r")).first().r


def test_pairs_as_a_whole(spark):
    assert reasons(spark, "sql", "Flask", "direct", "single_function", DIRECT, BOUND) == []
    assert reasons(spark, "sql", "Flask", "complex", "multi_function", COMPLEX, BOUND) == []
    assert reasons(spark, "sql", "API", "direct", "single_function", DIRECT.replace("@app.get('/u')\n", ""), BOUND) == ["before: another application type"]
    assert reasons(spark, "sql", "Flask", "complex", "class_based", DIRECT, BOUND) == ["before: another structure", "before: another flow"]
    assert "after: still SQL injection" in reasons(spark, "sql", "Flask", "direct", "single_function", DIRECT, DIRECT)
    assert reasons(spark, "xss", "Flask", "direct", "single_function", "def (", "x")[0] == "before: not valid Python"
    assert reasons(spark, "other", "Flask", "direct", "single_function", "x", "x")[-1] == "no check for this class"


RULES = [
    ("app.config['WTF_CSRF_ENABLED'] = False", ["csrf-disabled"]), ("csrf.exempt(view)", ["csrf-disabled"]), ("csrf = CSRFProtect(app)", []),
    ("return redirect(request.args.get('next'))", ["open-redirect"]), ("return redirect(next_url)", ["open-redirect"]), ("if urlparse(next_url).netloc: pass\nreturn redirect(next_url)", []), ("return redirect('/home')", []),
    ("return f\"SELECT * FROM t WHERE n = '{n}'\"", ["sql-text-returned"]), ("return 'SELECT 1', (n,)", []), ("return render_template_string('<b>' + n)", ["html-built"]), ("return render_template_string('<b>' + escape(n))", []),
]


def test_pattern_rules_match_and_pass_over(spark):
    df = spark.createDataFrame(RULES, "c string, want array<string>")
    for r in df.select("c", "want", rules.pattern_findings(F.col("c")).alias("v")).collect():
        assert r.v == r.want, r.c
