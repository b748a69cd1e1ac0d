"""Candidates from a provider's replies: text of a response, the JSON in it, normalised fields and parts."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.pycode import unified_diff
from sluicebox.functions.registry import MODES
from sluicebox.functions.text import changed_parts, json_object, let, lines, lines_present, normal_code, string_list, strip

CANDIDATE = "commit_message STRING, filename STRING, vulnerable_code STRING, fixed_code STRING, diff STRING, badparts ARRAY<STRING>, goodparts ARRAY<STRING>, error STRING"
REQUIRED = ("commit_message", "vulnerable_code", "fixed_code")

#: Marks of lines, by class, of the code before and after. Classes with conditions of their own are below.
BEFORE = {
    "sql": ["execute(", "select", "insert", "update", "delete"],
    "command_injection": ["os.system(", "shell=true", "subprocess.getoutput("],
    "directory_traversal": ["input(", "open(", "os.path.join", "request.args", "send_file("],
    "remote_code_execution": ["compile(", "eval(", "exec("],
    "xss": ["markup(", "render_template_string", "return '<", 'return "<'],
}
AFTER = {
    "directory_traversal": [".resolve()", "commonpath", "parents", "relative_to", "safe_join"],
    "open_redirect": ["allowed", "netloc", "scheme", "startswith", "urlparse"],
    "remote_code_execution": ["ast.literal_eval", "dispatch", "literal_eval", "whitelist"],
    "xss": ["escape(", "render_template(", "{{"],
    "xsrf": ["csrf_protect", "csrfmiddlewaretoken", "csrfprotect", "wtf_csrf_enabled"],
}


def response_text(body: Column) -> Column:
    """The text of a provider's response (JSON): of its first choice, else of the first known field, else of all pieces of a list of outputs; null where there is none."""
    get = lambda path: F.get_json_object(body, path)
    choices = get("$.choices").isNotNull()
    choice = F.when(get("$.choices[0].message").isNotNull(), F.coalesce(get("$.choices[0].message.content"), F.lit(""))).otherwise(get("$.choices[0].text"))
    fields = F.coalesce(*[get(f"$.{f}") for f in ("output_text", "response", "generated_text", "text", "content")])
    outputs = F.from_json(get("$.output"), "array<struct<content:array<struct<text:string>>>>")
    pieces = F.filter(F.flatten(F.transform(outputs, lambda x: F.coalesce(x["content"], F.array().cast("array<struct<text:string>>")))), lambda x: x["text"].isNotNull())
    joined = F.when(F.size(pieces) > 0, F.array_join(F.transform(pieces, lambda x: x["text"]), "\n"))
    return F.coalesce(F.when(choices, choice), fields, joined)


def _marked(own: Column, low: Column, marks: list[str]) -> Column:
    """The lines that hold one of the marks in any case; ``low`` has the lines in lower case."""
    hit = lambda x: functools.reduce(operator.or_, [F.contains(x, F.lit(m.lower())) for m in marks])
    return F.filter(own, lambda x, i: hit(F.get(low, i)))


def vulnerable_of(mode: Column, own: Column, low: Column) -> Column:
    """:func:`vulnerable_lines` of the code's lines, which are also given in lower case."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for m, marks in BEFORE.items():
        out = out.when(mode == m, _marked(own, low, marks))
    redirect = F.filter(own, lambda x: F.contains(x, F.lit("redirect(")) & ~x.startswith("from ") & ~x.startswith("import "))
    posts = F.filter(own, lambda x, i: F.contains(F.get(low, i), F.lit("methods=")) & F.contains(F.get(low, i), F.lit("post")))
    either = let(_marked(own, low, ["csrf.exempt", "wtf_csrf_enabled"]), lambda off: F.when(F.size(off) > 0, off).otherwise(posts))
    return out.when(mode == "open_redirect", redirect).when(mode == "xsrf", either).otherwise(F.array().cast("array<string>"))


def fixed_of(mode: Column, own: Column, low: Column) -> Column:
    """:func:`fixed_lines` of the code's lines, which are also given in lower case."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for m, marks in AFTER.items():
        out = out.when(mode == m, _marked(own, low, marks))
    has = lambda x, *marks: functools.reduce(operator.or_, [F.contains(x, F.lit(m)) for m in marks])
    bound = F.filter(own, lambda x: F.contains(x, F.lit("execute(")) & has(x, "?", "%s", ", ("))
    listed = F.filter(own, lambda x: has(x, "subprocess.run([", "shell=False"))
    return out.when(mode == "sql", bound).when(mode == "command_injection", listed).otherwise(F.array().cast("array<string>"))


def _of_code(of: Callable[[Column, Column, Column], Column], mode: Column, code: Column) -> Column:
    return let(lines(code), lambda own: let(F.transform(own, F.lower), lambda low: of(mode, own, low)))


def vulnerable_lines(mode: Column, code: Column) -> Column:
    """The lines that show the weakness, by class and marks; none for unknown classes."""
    return _of_code(vulnerable_of, mode, code)


def fixed_lines(mode: Column, code: Column) -> Column:
    return _of_code(fixed_of, mode, code)


def normalise(rows: DataFrame, reply: str, mode: str, name: str = "candidate") -> DataFrame:
    """rows with ``name``, a struct of CANDIDATE, of the JSON object in the reply's text.

    ``error`` says why there is no candidate: no JSON object, or required fields that are missing
    or blank. File names end in .py; line ends are LF. The parts are those of the diff, unless the
    reply names lines that all stand in the code; where a side has none, they are inferred by class.
    """
    v = F.try_parse_json(json_object(F.col(reply)))
    get = lambda f: F.try_variant_get(v, f"$.{f}", "string")
    listed = lambda f: string_list(F.coalesce(F.try_variant_get(v, f"$.{f}", "array<string>"), F.array(get(f))))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    blank = [F.when(strip(F.coalesce(get(f), F.lit(""))) == "", F.lit(f)) for f in REQUIRED]
    lost = F.array_join(F.filter(F.array(*blank), lambda x: x.isNotNull()), ", ")
    error = F.when(~is_object, "no JSON object").when(lost != "", F.concat(F.lit("missing fields: "), lost))
    file = strip(F.coalesce(F.nullif(get("filename"), F.lit("")), F.lit("app.py")))
    c = rows.withColumns({"_error": error, "_file": F.when(file.endswith(".py"), file).otherwise(F.concat(file, F.lit(".py"))), "_before": normal_code(get("vulnerable_code")), "_after": normal_code(get("fixed_code")), "_bad": listed("vulnerable_lines"), "_good": listed("fixed_lines"), "_msg": strip(get("commit_message"))})
    c = c.withColumn("_diff", unified_diff(F.col("_before"), F.col("_after"), F.col("_file")))

    def parts(named: str, code: str, sign: str, inferred: Column) -> Column:
        found = F.when((F.size(named) > 0) & lines_present(F.col(code), F.col(named)), F.col(named)).otherwise(changed_parts(F.col("_diff"), sign))
        return F.when(F.size(found) > 0, found).otherwise(inferred)

    bad = parts("_bad", "_before", "-", vulnerable_lines(F.col(mode), F.col("_before")))
    good = parts("_good", "_after", "+", fixed_lines(F.col(mode), F.col("_after")))
    good_row = F.col("_error").isNull()
    one = lambda x: F.when(good_row, x)
    out = F.struct(one(F.col("_msg")).alias("commit_message"), one(F.col("_file")).alias("filename"), one(F.col("_before")).alias("vulnerable_code"), one(F.col("_after")).alias("fixed_code"), one(F.col("_diff")).alias("diff"), one(bad).alias("badparts"), one(good).alias("goodparts"), F.col("_error").alias("error"))
    return c.withColumn(name, out).select(*rows.columns, name)


#: A reply for each class, for runs without a provider: code before, code after.
_PAIRS = {
    "sql": ("def find(cursor, name):\n    cursor.execute(f\"SELECT id FROM users WHERE name = '{name}'\")", "def find(cursor, name):\n    cursor.execute('SELECT id FROM users WHERE name = ?', (name,))"),
    "command_injection": ("import subprocess\ndef ping(host):\n    subprocess.run('ping ' + host, shell=True)", "import subprocess\ndef ping(host):\n    subprocess.run(['ping', host], shell=False)"),
    "directory_traversal": ("def read(base):\n    return open(base + input()).read()", "def read(base):\n    target = (base / input()).resolve()\n    target.relative_to(base)\n    return target.read_text()"),
    "open_redirect": ("def go(request):\n    return redirect(request.args['next'])", "def go(request):\n    target = urlparse(request.args['next'])\n    return redirect(target.path if not target.netloc else '/')"),
    "remote_code_execution": ("def run(text):\n    return eval(text)", "import ast\ndef run(text):\n    return ast.literal_eval(text)"),
    "xss": ("def page(name):\n    return render_template_string('<b>%s</b>' % name)", "def page(name):\n    return render_template_string('<b>%s</b>' % escape(name))"),
    "xsrf": ("app.config['WTF_CSRF_ENABLED'] = False", "csrf = CSRFProtect(app)"),
}


def constant_replies(spark: SparkSession) -> DataFrame:
    """``mode, reply``: a constant candidate of each class, as a provider would give it."""
    import json

    rows = [(m, json.dumps({"commit_message": f"Fix {m}", "filename": "app", "vulnerable_code": _PAIRS[m][0], "fixed_code": _PAIRS[m][1]})) for m in MODES]
    return spark.createDataFrame(rows, "mode string, reply string")


PASSING_REVIEW = '{"verdict": "pass", "cwe_correct": true, "fix_correct": true, "context_correct": true, "runtime_plausible": true, "reason_category": "none"}'
