"""Structural checks of a code pair: text predicates as column expressions, and one parse per text for what needs a syntax tree."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicebox.functions.pycode import called, names_called

#: Names that modules of common frameworks export; an import of another name from them is made up.
EXPORTS = {
    "flask": "Flask request Response redirect abort render_template render_template_string url_for session g escape flash jsonify make_response send_file send_from_directory current_app Blueprint stream_with_context",
    "flask_wtf": "FlaskForm CSRFProtect",
    "wtforms": "StringField PasswordField SubmitField BooleanField SelectField",
    "django.db": "connection",
    "django.http": "HttpRequest JsonResponse FileResponse HttpResponse HttpResponseRedirect HttpResponsePermanentRedirect HttpResponseNotFound HttpResponseForbidden HttpResponseBadRequest HttpResponseServerError HttpResponseNotAllowed StreamingHttpResponse",
    "django.utils.html": "format_html escape",
    "django.views": "View",
    "markupsafe": "escape Markup",
}
_EXPORTS = {module: set(names.split()) for module, names in EXPORTS.items()}
_VERBS = ("select ", "insert ", "update ", "delete ")
_RUN = {"execute", "executemany"}
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)

FACTS = "parses boolean, functions int, classes int, bound_sql boolean, bound_sql_percent boolean, raw_rows boolean, flow_direct boolean, flow_indirect boolean, flow_complex boolean, operator_table boolean, unknown_imports array<string>"


def _targets(node: ast.Assign | ast.AnnAssign) -> list[str]:
    return [t.id for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) if isinstance(t, ast.Name)]


def _assigned(root: ast.AST) -> Iterator[ast.Assign | ast.AnnAssign]:
    return (n for n in ast.walk(root) if isinstance(n, (ast.Assign, ast.AnnAssign)) and n.value is not None)


def _runs_sql(node: ast.AST) -> bool:
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in _RUN


class _Queries:
    """Query strings that can be followed from a literal to a call, over names and helper functions."""

    def __init__(self, tree: ast.AST):
        self.functions = [n for n in ast.walk(tree) if isinstance(n, _DEF)]
        self.names = self._literals(tree)
        self.helpers: dict[str, tuple[str, bool]] = {}
        self.value_names: set[str] = set()
        for f in self.functions:
            own = self._literals(f)
            for r in (n.value for n in ast.walk(f) if isinstance(n, ast.Return) and n.value is not None):
                parts = r.elts if isinstance(r, ast.Tuple) and r.elts else [r]
                if query := self.text(parts[0], own):
                    self.helpers[f.name] = query, len(parts) > 1 and isinstance(parts[1], (ast.Tuple, ast.List, ast.Dict))
        for n in ast.walk(tree):
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and called(n.value) in self.helpers:
                query, with_values = self.helpers[called(n.value)]
                for t in n.targets:
                    pair = t.elts if isinstance(t, ast.Tuple) else [t]
                    if pair and isinstance(pair[0], ast.Name):
                        self.names[pair[0].id] = query
                    if with_values and len(pair) > 1 and isinstance(pair[1], ast.Name):
                        self.value_names.add(pair[1].id)
        self.runners = {f.name for f in self.functions for n in ast.walk(f) if _runs_sql(n) and len(n.args) > 1 and {getattr(a, "id", "") for a in n.args[:2]} <= {a.arg for a in f.args.args}}
        self.calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and len(n.args) > 1 and (_runs_sql(n) or called(n) in self.runners)]

    def _literals(self, root: ast.AST) -> dict[str, str]:
        found: dict[str, str] = {}
        for n in _assigned(root):
            if query := self.text(n.value, found):
                found.update(dict.fromkeys(_targets(n), query))
        return found

    def text(self, node: ast.AST, names: dict[str, str], follow: bool = False) -> str | None:
        if isinstance(node, ast.Constant):
            return node.value if isinstance(node.value, str) else None
        if isinstance(node, ast.Name):
            return names.get(node.id)
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name) and node.func.id == "text" and node.args:
                return self.text(node.args[0], names, follow)
            if follow and called(node) in self.helpers:
                return self.helpers[called(node)][0]
        return None

    def bound(self) -> list[str]:
        """The texts of all queries that are run with separate values."""
        known = [c for c in self.calls if isinstance(c.args[1], (ast.Tuple, ast.List, ast.Dict)) or getattr(c.args[1], "id", None) in self.value_names]
        return [q for c in known if (q := self.text(c.args[0], self.names, True))]


def _raw_rows(tree: ast.AST) -> bool:
    rows = {t for n in _assigned(tree) if isinstance(n.value, ast.Call) and getattr(n.value.func, "attr", "") in ("fetchone", "fetchall") for t in _targets(n)}
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and getattr(n.func, "id", "") in ("HttpResponse", "JsonResponse"):
            for v in (*n.args, *(k.value for k in n.keywords)):
                if any(isinstance(x, ast.Name) and x.id in rows for x in (v.values if isinstance(v, ast.Dict) else [v])):
                    return True
    return False


def _composed(root: ast.AST) -> bool:
    """SQL text put together at run time somewhere below."""
    if not any(v in ast.unparse(root).lower() for v in _VERBS):
        return False
    for n in ast.walk(root):
        if isinstance(n, ast.JoinedStr) or (isinstance(n, ast.BinOp) and isinstance(n.op, (ast.Add, ast.Mod))):
            return True
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "format":
            return True
    return False


def _reads_user(scope: ast.AST) -> bool:
    for n in ast.walk(scope):
        if isinstance(n, ast.Call) and getattr(n.func, "id", "") == "input":
            return True
        root = n
        while isinstance(root, ast.Attribute):
            root = root.value
        if root is not n and getattr(root, "id", "") in ("request", "sys"):
            return True
    return False


def _builds(scope: ast.AST) -> bool:
    made = {t for n in _assigned(scope) if _composed(n.value) for t in _targets(n)}
    results = [n.value for n in ast.walk(scope) if isinstance(n, ast.Return) and n.value is not None]
    return any(_composed(r) or (isinstance(r, ast.Name) and r.id in made) for r in results)


def _runs_parameter(scope: ast.FunctionDef | ast.AsyncFunctionDef) -> bool:
    own = {a.arg for a in scope.args.args}
    return any(_runs_sql(n) and n.args and isinstance(n.args[0], ast.Name) and n.args[0].id in own for n in ast.walk(scope))


def _flows(functions: list) -> tuple[bool, bool, bool]:
    """direct: one function reads, composes and runs; indirect: one reads, another composes and runs; complex: a chain of
    reader, builder and runner, joined by a function that calls the last two."""
    reads = [_reads_user(f) for f in functions]
    acts = [_composed(f) and any(map(_runs_sql, ast.walk(f))) for f in functions]
    direct = any(a and b for a, b in zip(reads, acts))
    indirect = any(a and b for i, a in enumerate(reads) for j, b in enumerate(acts) if i != j)
    by_name = {f.name: f for f in functions}
    readers = {f.name for f, r in zip(functions, reads) if r}
    builders, runners = ({n for n, f in by_name.items() if test(f)} for test in (_builds, _runs_parameter))
    calls = {n: set(names_called(f)) - {""} for n, f in by_name.items()}
    for n, reached in calls.items():
        if any(b != r for b in builders & reached for r in runners & reached) and (n in readers or reached & readers or any(n in calls[x] for x in readers)):
            return direct, indirect, True
    return direct, indirect, False


def code_facts(code: str | None) -> tuple:
    """The values of FACTS for one text; a text without a syntax tree has none of the properties."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the parser's own stack is a MemoryError
        return False, 0, 0, False, False, False, False, False, False, False, []
    nodes = list(ast.walk(tree))
    queries = _Queries(tree)
    bound = queries.bound()
    table = any(isinstance(n, ast.Dict) and any(isinstance(v, ast.Attribute) and getattr(v.value, "id", "") == "operator" for v in n.values) for n in nodes)
    strange = [f"{n.module}.{a.name}" for n in nodes if isinstance(n, ast.ImportFrom) and not n.level and n.module in _EXPORTS for a in n.names if a.name != "*" and a.name not in _EXPORTS[n.module]]
    percent = any("%s" in q for q in bound)
    marked = percent or any("?" in q or re.search(r":[A-Z_a-z]", q) for q in bound)
    return (True, len(queries.functions), sum(isinstance(n, ast.ClassDef) for n in nodes), marked, percent, _raw_rows(tree), *_flows(queries.functions), table, strange)


def facts(column):  # noqa: ANN001, ANN201
    """A struct of FACTS, by an Arrow UDF: no built-in function parses Python."""

    @F.pandas_udf(FACTS)
    def parse(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([code_facts(c) for c in codes], columns=[x.split()[0] for x in FACTS.split(", ")])

    return parse(column)


# --- text predicates --------------------------------------------------------------------------


def holds(c: Column, *marks: str) -> Column:
    """Whether one of the marks stands in the text."""
    found = F.contains(c, F.lit(marks[0]))
    for m in marks[1:]:
        found = found | F.contains(c, F.lit(m))
    return found


def sql_injection(c: Column) -> Column:
    low = F.lower(c)
    composed = c.rlike(r"""execute\s*\(\s*f["']""") | c.rlike(r"""(?:=|return\s)\s*f["']""") | holds(c, " + ", " % ", ".format(")
    return holds(low, *(f".{x}(" for x in sorted(_RUN))) & holds(low, *_VERBS) & composed


def shell_call(c: Column) -> Column:
    return holds(c, "shell=True", "os.system(", "subprocess.getoutput(")


def listed_subprocess(c: Column) -> Column:
    return holds(c, "subprocess.run([") & ~holds(c, "shell=True")


def path_traversal(c: Column) -> Column:
    low = F.lower(c)
    return holds(low, "input(", "sys.argv", "request.form", "request.args") & holds(low, "open(", "send_file(") & ~holds(low, "commonpath", "safe_join", ".resolve()")


def path_containment(c: Column) -> Column:
    """A resolved path compared as a path; a comparison of string beginnings doesn't count."""
    low = F.lower(c)
    compared = holds(low, ".relative_to(", ".is_relative_to(") | (holds(low, ".parents") & holds(low, " in ")) | (holds(low, "commonpath(") & holds(low, "!=", "=="))
    joined = F.when(holds(low, "safe_join("), holds(low, "== none", " is none")).otherwise(holds(low, "os.path.realpath(", ".resolve(") & compared)
    return ~holds(low, ".startswith(") & joined


def open_redirect(c: Column) -> Column:
    low = F.lower(c)
    return holds(low, "redirect(") & holds(low, "url", "next", "target", "request.args")


def redirect_validation(c: Column) -> Column:
    low = F.lower(c)
    return holds(low, "redirect(") & holds(low, "allowed", "scheme", "netloc", "urlparse", "startswith")


def dynamic_code(c: Column) -> Column:
    return c.rlike(r"(?U)\b(?:exec|eval|compile)\s*\(")


def code_replacement(c: Column, found: Column) -> Column:
    return holds(F.lower(c), "dispatch", "whitelist", "allowed_operations", "ast.literal_eval") | found["operator_table"]


def xss(c: Column) -> Column:
    low = F.lower(c)
    return holds(low, "response(", "render_template_string") & holds(c, "%", " + ", "f'", 'f"', "Markup(", ".format(") & ~holds(low, "escape(")


def xss_fix(c: Column) -> Column:
    return holds(F.lower(c), "render_template(", "format_html(", "escape(", "{{")


def csrf_issue(c: Column) -> Column:
    low = F.lower(c)
    posts = holds(low, "@app.post", "methods=['post'", 'methods=["post"')
    return (holds(low, "csrf_enabled") & holds(low, "false")) | (posts & ~holds(low, "csrf_protect", "csrfprotect", "csrfmiddlewaretoken"))


def csrf_fix(c: Column) -> Column:
    return holds(F.lower(c), "csrf_protect", "csrfprotect", "csrfmiddlewaretoken", 'wtf_csrf_enabled"] = true')


def csrf_order(c: Column) -> Column:
    """Where the protection wraps an app, the app is made before."""
    low = F.lower(c)
    wrap, app = F.instr(low, "csrfprotect(app)"), F.instr(low, "app = flask")
    return (wrap == 0) | ((app > 0) & (app < wrap))


def http_route(low: Column) -> Column:
    return holds(low, "add_url_rule(", "@router.", "@blueprint.", *(f"@app.{x}" for x in ("delete", "get", "post", "put", "route")))


def application(kind: Column, c: Column) -> Column:
    low = F.lower(c)
    flask = holds(low, "flask") & http_route(low)
    plain = ~holds(low, "fastapi", "django", "flask") & holds(low, "argparse", "sys.argv", "input(")
    return (
        F.when(kind == "Flask", flask)
        .when(kind == "Django", holds(low, "django") & holds(low, "view", "request"))
        .when(kind == "API", flask | (holds(low, "fastapi") & http_route(low)))
        .when(kind.isin("CLI", "script"), plain)
        .otherwise(F.lit(False))
    )


def structure(kind: Column, f: Column) -> Column:
    one = (f["functions"] == 1) & (f["classes"] == 0)
    return F.when(kind == "single_function", one).when(kind == "multi_function", f["functions"] > 1).when(kind == "class_based", f["classes"] > 0).otherwise(F.lit(False))


def flow(kind: Column, f: Column) -> Column:
    return F.when(kind.isin("direct", "indirect", "complex"), F.when(kind == "direct", f["flow_direct"]).when(kind == "indirect", f["flow_indirect"]).otherwise(f["flow_complex"])).otherwise(F.lit(False))


def structural_reasons(mode: Column, app: Column, pattern: Column, shape: Column, before: Column, after: Column, seen: Column, fixed: Column) -> Column:
    """Why a pair doesn't show its weakness and fix, in order; ``seen`` and ``fixed`` are the facts of both texts.

    The flow pattern is checked for SQL only. Nothing about the context is said of a text that doesn't parse.
    """
    strange = lambda which, f: F.transform(f["unknown_imports"], lambda x: F.concat(F.lit(f"{which} imports a name that doesn't exist: "), x))
    one = lambda cond, message: F.when(cond, F.lit(message))
    django = app == "Django"
    checks: dict[str, list[Column]] = {
        "sql": [one(~sql_injection(before), "before: no SQL injection"), one(~F.when(django, fixed["bound_sql_percent"]).otherwise(fixed["bound_sql"]), "after: no bound parameters"), one(sql_injection(after), "after: still SQL injection"), one(django & fixed["raw_rows"], "after: database rows in a response")],
        "command_injection": [one(~shell_call(before), "before: no shell call"), one(~listed_subprocess(after), "after: no argument list"), one(holds(after, "os.system(", "shell=True"), "after: still a shell call")],
        "directory_traversal": [one(~path_traversal(before), "before: no path traversal"), one(~path_containment(after), "after: no path-safe containment")],
        "open_redirect": [one(~open_redirect(before), "before: no open redirect"), one(~redirect_validation(after), "after: target not validated")],
        "remote_code_execution": [one(~dynamic_code(before), "before: no dynamic code"), one(dynamic_code(after), "after: still dynamic code"), one(~code_replacement(after, fixed), "after: no safe replacement")],
        "xss": [one(~xss(before), "before: no unescaped HTML"), one(~xss_fix(after), "after: nothing escapes")],
        "xsrf": [one(~csrf_issue(before), "before: no CSRF weakness"), one(~csrf_fix(after), "after: no CSRF protection"), one(~csrf_order(after), "after: protection before the app"), one(holds(after, "WTF_CSRF_ENABLED\"] = False", "WTF_CSRF_ENABLED'] = False"), "after: CSRF protection off")],
    }
    own = F.when(F.lit(False), F.array().cast("array<string>"))
    for m, reasons in checks.items():
        own = own.when(mode == m, F.array(*reasons))
    context = F.array(
        one(seen["parses"] & ~application(app, before), "before: another application type"),
        one(seen["parses"] & ~structure(shape, seen), "before: another structure"),
        one(seen["parses"] & (mode == "sql") & ~flow(pattern, seen), "before: another flow"),
    )
    parsed = lambda which, f: F.array(one(~f["parses"], f"{which}: not valid Python"))
    every = F.concat(parsed("before", seen), strange("before", seen), parsed("after", fixed), strange("after", fixed), context, own.otherwise(F.array(F.lit("no check for this class"))))
    return F.filter(every, lambda x: x.isNotNull())


#: Rule files that are plain patterns: the sink's pattern, and one that excuses the text.
PATTERN_RULES = {
    "csrf-disabled": (r"(?i)(?:WTF_CSRF_ENABLED[\"']?\]?\s*=\s*False|csrf\.exempt)", None),
    "open-redirect": (r"(?s)\b(?:redirect|HttpResponseRedirect|RedirectResponse)\s*\(\s*(?:request\.(?:args|form|GET|POST)\.get|(?:target|next_url|next|url)\b)", r"urlparse|netloc|scheme|allowed|startswith\s*\("),
    "sql-text-returned": (r"""(?i)\breturn\s+(?:f["'][^\n]*(?:select|insert|update|delete|replace|with)\b[^\n]*["']|["']\s*(?:select|insert|update|delete|replace|with)\b[^"'\n]*["']\s*(?:\+|%|\.format\())""", None),
    "html-built": (r"""render_template_string\s*\([^)]*(?:\+|%|\.format\(|Markup\(|f["'])|(?:HttpResponse|Response)\s*\(\s*f["']|return\s+f?["']\s*<[^\n]*(?:\+|%|\.format\(|\{)""", r"escape\s*\(|format_html\s*\("),
}


def pattern_findings(c: Column) -> Column:
    """Ids of the pattern rules that the text meets, sorted."""
    each = [F.when(c.rlike(sink) & (~c.rlike(excuse) if excuse else F.lit(True)), F.lit(name)) for name, (sink, excuse) in sorted(PATTERN_RULES.items())]
    return F.filter(F.array(*each), lambda x: x.isNotNull())
