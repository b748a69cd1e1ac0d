from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_policy_verify import AFTER, BEFORE, record, table  # noqa: F401

from sluicebox.functions.scan import scan, tree_findings
from sluicebox.operators import validation

CASES = [
    ("import subprocess\nsubprocess.run(c, shell=True)", ["cwe-78.command-injection"]), ("os.system(c)", ["cwe-78.command-injection"]), ("subprocess.run([c], shell=False)", []), ("subprocess.getoutput(c)", ["cwe-78.command-injection"]),
    ("p = os.path.join(a, b)", ["cwe-22.path-traversal"]), ("p = Path(a) / b", []), ("eval(x)", ["cwe-94.remote-code-execution"]), ("ast.literal_eval(x)", []), ("obj.exec(x)", []),
    ("c.execute(f'SELECT {x}')", ["cwe-89.sql-injection"]), ("c.execute('SELECT ' + x)", ["cwe-89.sql-injection"]), ("c.execute('SELECT %s' % x)", ["cwe-89.sql-injection"]), ("c.execute('SELECT ?', (x,))", []), ("q = f'SELECT {x}'\nc.execute(q)", ["cwe-89.sql-injection"]),
    ("q = 'SELECT ' + x\nc.execute(q)", ["cwe-89.sql-injection"]), ("q = f'SELECT {x}'\nc.execute(q, (x,))", []), ("sql += f' AND {x}'", ["cwe-89.sql-injection"]), ("html += f'<b>{x}'", []), ("def f():\n    q = f'{x}'\ndef g():\n    c.execute(q)", []),
    ("v = request.args.get('a')\nreturn_ = Response('<b>' + v)", ["cwe-79.xss"]), ("v = escape(request.args.get('a'))\nx = Response('<b>' + v)", []), ("x = HttpResponse(request.GET.get('a'))", []), ("v = request.GET.get('a')\nx = HttpResponse(v)", ["cwe-79.xss"]),
    ("v = request.form['a']\nx = render_template_string(v)", ["cwe-79.xss"]), ("v = request.form['a']\nv = 'b'\nx = render_template_string(v)", []), ("x = Response('<b>')", []), ("def (", []), (None, []),
]


@pytest.mark.parametrize(("code", "want"), CASES)
def test_rules_of_the_tree(code, want):
    assert tree_findings(code) == want


def test_all_rules_over_a_column(spark):
    df = spark.createDataFrame([("app.config['WTF_CSRF_ENABLED'] = False\nos.system(x)",), ("def f():\n    return f\"SELECT {x}\"",), (None,)], "c string")
    assert [r.v for r in df.select(scan(F.col("c")).alias("v")).collect()] == [["rules.cwe-352.csrf-disabled", "rules.cwe-78.command-injection"], ["rules.cwe-89.sql-injection"], []]


def test_scans_stand_in_for_missing_runs(table):  # noqa: F811
    v = {k: x for k, x in record(1)["validation"].items() if not k.startswith("semgrep")}
    out = {r.ord: r.validation for r in validation.validate(validation.with_scans(table(record(1, validation=v), record(2, validation=v, fixed_code=BEFORE), record(3, validation=None)))).collect()}
    assert out[1].passed and out[1].warnings == [] and [x.check_id for x in out[1].semgrep_before.findings] == ["rules.cwe-89.sql-injection"] and AFTER
    assert "expected rules still reported after the fix: rules.cwe-89.sql-injection" in out[2].reasons
    assert out[3].warnings == ["bandit is not available"]
