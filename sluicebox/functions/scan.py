"""The rule set over a text: plain patterns and patterns of the syntax tree, so that a scanner's run can be made where there is none."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicebox.functions.pycode import called
from sluicebox.functions.rules import PATTERN_RULES

#: Which rule a plain pattern belongs to.
RULE_OF = {"csrf-disabled": "cwe-352.csrf-disabled", "open-redirect": "cwe-601.open-redirect", "sql-text-returned": "cwe-89.sql-injection", "html-built": "cwe-79.xss-helper"}
_QUERY = re.compile(r"query|sql|statement", re.I)
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Module)
_CLEAN = {"escape", "format_html"}
_READS = {"GET", "args", "form"}


def _dotted(node: ast.AST) -> str:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, node.id])) if isinstance(node, ast.Name) else ""


def _text(node: ast.AST) -> bool:
    return isinstance(node, ast.JoinedStr) or (isinstance(node, ast.Constant) and isinstance(node.value, str))


def _joined(node: ast.AST, signs: tuple = (ast.Add, ast.Mod)) -> bool:
    """A text put together with a value: formatted, or a text and a sign before something."""
    return isinstance(node, ast.JoinedStr) or (isinstance(node, ast.BinOp) and isinstance(node.op, signs) and (_text(node.left) or _joined(node.left, signs)))


def _own(scope: ast.AST) -> Iterator[ast.AST]:
    """The nodes of a scope in the order of the text, without those of functions within it."""
    todo = list(ast.iter_child_nodes(scope))
    while todo:
        n = todo.pop(0)
        yield n
        if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            todo[:0] = ast.iter_child_nodes(n)


def _sql(scope: ast.AST) -> bool:
    made: set[str] = set()
    for n in _own(scope):
        if isinstance(n, ast.Assign) and _joined(n.value):
            made |= {t.id for t in n.targets if isinstance(t, ast.Name)}
        if isinstance(n, ast.AugAssign) and isinstance(n.op, ast.Add) and _QUERY.search(ast.unparse(n.target)) and _joined(n.value, (ast.Add,)):
            return True
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and len(n.args) == 1 and not n.keywords:
            first = n.args[0]
            if n.func.attr == "execute" and (_joined(first) or getattr(first, "id", None) in made):
                return True
            if n.func.attr == "executemany" and isinstance(first, ast.JoinedStr):
                return True
    return False


def _source(n: ast.AST) -> bool:
    """A value of a request: GET, args or form, by get() or by key."""
    if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "get":
        return isinstance(n.func.value, ast.Attribute) and n.func.value.attr in _READS
    return isinstance(n, ast.Subscript) and isinstance(n.value, ast.Attribute) and n.value.attr == "form"


def _tainted(node: ast.AST, names: set[str]) -> bool:
    if isinstance(node, ast.Call) and called(node) in _CLEAN:
        return False
    if _source(node) or (isinstance(node, ast.Name) and node.id in names):
        return True
    return any(_tainted(c, names) for c in ast.iter_child_nodes(node))


def _html(scope: ast.AST) -> bool:
    names: set[str] = set()
    for n in _own(scope):
        if isinstance(n, (ast.Assign, ast.AugAssign, ast.AnnAssign)) and n.value is not None:
            targets = {t.id for t in (n.targets if isinstance(n, ast.Assign) else [n.target]) if isinstance(t, ast.Name)}
            if _tainted(n.value, names):
                names |= targets
            elif not isinstance(n, ast.AugAssign):
                names -= targets
        if isinstance(n, ast.Call) and n.args and isinstance(n.func, ast.Name):
            first, name = n.args[0], n.func.id
            of_object = isinstance(first, ast.Attribute) or (isinstance(first, ast.Call) and isinstance(first.func, ast.Attribute))
            one = len(n.args) == 1 and not n.keywords
            sink = (name == "render_template_string" and one) or (name == "HttpResponse" and one and not of_object) or (name == "Response" and not of_object)
            if sink and _tainted(first, names):
                return True
    return False


def tree_findings(code: str | None) -> list[str]:
    """Rules that the syntax tree meets, sorted; none for a text without one."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            name = _dotted(n.func)
            shell = name.startswith("subprocess.") and any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in n.keywords)
            if shell or name in ("os.system", "subprocess.getoutput"):
                found.add("cwe-78.command-injection")
            if name == "os.path.join":
                found.add("cwe-22.path-traversal")
            if name in ("eval", "exec", "compile"):
                found.add("cwe-94.remote-code-execution")
        if isinstance(n, _SCOPES):
            found |= {r for r, test in (("cwe-89.sql-injection", _sql), ("cwe-79.xss", _html)) if test(n)}
    return sorted(found)


def scan(c: Column, prefix: str = "rules") -> Column:
    """Ids of all rules that the text meets, with the rule set's name in front, sorted."""

    @F.pandas_udf("array<string>")
    def by_tree(codes: pd.Series) -> pd.Series:
        return pd.Series([tree_findings(x) for x in codes], dtype=object)

    plain = [F.when(c.rlike(sink) & (~c.rlike(excuse) if excuse else F.lit(True)), F.lit(RULE_OF[name])) for name, (sink, excuse) in sorted(PATTERN_RULES.items())]
    both = F.concat(F.filter(F.array(*plain), lambda x: x.isNotNull()), by_tree(c))
    return F.transform(F.array_sort(F.array_distinct(both)), lambda x: F.concat(F.lit(f"{prefix}."), x))
