"""Prompt text of a planned record, put together from its context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicebox.functions.registry import CLASSES

APPLICATION = {
    "Flask": "a Flask app with a route that handles the request, and no second framework",
    "Django": "a Django view with Django's own database access, and no second framework",
    "API": "an HTTP endpoint in Flask or FastAPI",
    "script": "a plain script that reads sys.argv or input()",
    "CLI": "a command-line tool that reads sys.argv or input()",
}
FLOW = {"direct": "source and sink share a function", "indirect": "a handler reads the value, a helper holds the sink", "complex": "source, builder and sink are three functions, and one of them calls the other two"}
SHAPE = {"single_function": "one function, no class", "multi_function": "two functions or more, the flow crosses between them", "class_based": "a class whose method carries the flow"}
#: Shapes of html in turn, by sample index, for the class and applications that need variety.
HTML_FORMS = ["percent formatting into a local variable", "an f-string as the response", "str.format into a local variable", "a Response of a local variable"]
HTML_APPS = ["Flask", "API"]
PROFILE = {"compact": "fewer than 55 lines", "window_balanced": "420 to 900 tokens, clean code on both sides of the change"}


def _of(c: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)


def html_form(mode: Column, app: Column, index: Column) -> Column:
    """The form of html by ``index % 4``; null for other classes and applications."""
    return F.when((mode == "xss") & app.isin(HTML_APPS), F.get(F.array(*map(F.lit, HTML_FORMS)), (index % len(HTML_FORMS)).cast("int")))


def prompt(mode: Column, app: Column, flow: Column, shape: Column, level: Column, index: Column, profile: Column | None = None) -> Column:
    """A line for each demand; a value that isn't known has no line."""
    named = {c[0]: f"{c[1]} ({c[2]})" for c in CLASSES}
    line = lambda label, c: F.concat(F.lit(f"- {label}: "), c)
    static = F.when(mode == "sql", F.lit("- Fix: query text stays constant, values are bound")).otherwise(F.lit(None))
    rows = F.when((mode == "sql") & (app == "Django"), F.lit("- Fix: %s as the mark, fetched rows are made JSON before they leave"))
    form = html_form(mode, app, index)
    return F.concat_ws(
        "\n", F.lit("Write one Python commit that mends one weakness. Answer with one JSON object."), line("Weakness", _of(mode, named)), line("Application", _of(app, APPLICATION)), line("Flow", _of(flow, FLOW)), line("Shape", _of(shape, SHAPE)),
        line("Difficulty", level), line("Size", _of(profile if profile is not None else F.lit("compact"), PROFILE)), static, rows, line("HTML", form), F.lit("Fields: commit_message, filename, vulnerable_code, fixed_code, vulnerable_lines, fixed_lines."),
    )
