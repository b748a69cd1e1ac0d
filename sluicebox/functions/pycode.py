"""Arrow UDFs for what SQL has no words for: unified diffs, Python tokens, syntax trees."""

from __future__ import annotations

import ast
import difflib
import hashlib
import io
import keyword
import re
import tokenize
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import functions as F

SILENT = {tokenize.ENCODING, tokenize.ENDMARKER, tokenize.INDENT, tokenize.DEDENT, tokenize.NL, tokenize.NEWLINE, tokenize.COMMENT}
_KIND = {tokenize.STRING: "STRING", tokenize.NUMBER: "NUMBER"}


def diff_text(before: str | None, after: str | None, name: str | None) -> str:
    """Unified diff with three lines of context; equal texts give a lone line end."""
    old, new = ((x or "").splitlines() for x in (before, after))
    found = difflib.unified_diff(old, new, f"a/{name}", f"b/{name}", lineterm="")
    return "\n".join(found) + "\n"


def python_tokens(code: str | None) -> list[str]:
    """Token classes: keywords and operators as they are, names, strings and numbers by kind. Text that can't be tokenised is split by a pattern."""
    text = code or ""
    out: list[str] = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.NAME:
                out.append(t.string if keyword.iskeyword(t.string) else "NAME")
            elif t.type not in SILENT:
                out.append(_KIND.get(t.type, t.string))
    except (tokenize.TokenError, SyntaxError, MemoryError):
        found = re.findall(r"[A-Z_a-z]+|\d+|[^A-Z_a-z\s\d]", text)
        out = [x if keyword.iskeyword(x) else "NAME" if re.fullmatch("[A-Z_a-z]+", x) else "NUMBER" if x.isdigit() else x for x in found]
    return out


_NAMED = {ast.FunctionDef: ("name", "FUNC"), ast.AsyncFunctionDef: ("name", "FUNC"), ast.ClassDef: ("name", "CLASS"), ast.arg: ("arg", "ARG"), ast.Name: ("id", "NAME"), ast.Attribute: ("attr", "ATTR"), ast.alias: ("name", "ALIAS")}
_OPTIONAL = {ast.alias: ("asname", "ALIAS"), ast.keyword: ("arg", "KW"), ast.ExceptHandler: ("name", "NAME")}
_VALUES: tuple[tuple[type | tuple, str], ...] = ((type(None), "NONE"), (bool, "BOOL"), ((int, float, complex), "NUMBER"), (bytes, "BYTES"), (str, "STRING"))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def tree_print(code: str | None) -> str:
    """A hash of the syntax tree that doesn't change with names and literals; of the text, where there is no tree."""
    text = code or ""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the parser's own stack is a MemoryError
        return _digest("syntax-error|" + text.replace("\r\n", "\n").replace("\r", "\n").strip())
    for node in ast.walk(tree):
        kind = type(node)
        if kind in _NAMED:
            setattr(node, *_NAMED[kind])
        if kind in _OPTIONAL and getattr(node, _OPTIONAL[kind][0]):
            setattr(node, *_OPTIONAL[kind])
        if kind in (ast.Global, ast.Nonlocal):
            node.names = ["NAME"] * len(node.names)
        if kind is ast.Constant:
            node.value, node.kind = next((m for t, m in _VALUES if isinstance(node.value, t)), "CONSTANT"), None
    return _digest(ast.dump(tree))


def _typed(run: Callable, arity: int, kind: str):  # noqa: ANN202
    if arity == 1:

        def one(a: pd.Series) -> pd.Series:
            return run(a)

        return F.pandas_udf(one, kind)
    if arity == 2:

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)

        return F.pandas_udf(two, kind)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return F.pandas_udf(three, kind)


def unified_diff(*columns):  # noqa: ANN002, ANN201
    return _typed(lambda a, b, c: pd.Series([diff_text(*r) for r in zip(a, b, c)], dtype=object), 3, "string")(*columns)


def code_tokens(column):  # noqa: ANN001, ANN201
    return _typed(lambda a: pd.Series([python_tokens(x) for x in a], dtype=object), 1, "array<string>")(column)


def tree_fingerprint(column):  # noqa: ANN001, ANN201
    return _typed(lambda a: pd.Series([tree_print(x) for x in a], dtype=object), 1, "string")(column)


def names_called(node: ast.AST) -> Iterable[str]:
    for call in ast.walk(node):
        if isinstance(call, ast.Call):
            yield called(call)


def called(call: ast.Call) -> str:
    return getattr(call.func, "id", None) or getattr(call.func, "attr", None) or ""


def round_binary(column, digits: int = 6):  # noqa: ANN001, ANN201
    """Round half to even by the exact binary value, which SQL's round, by the shortest decimal form, doesn't do."""
    return _typed(lambda a: pd.Series([None if pd.isna(x) else round(float(x), digits) for x in a], dtype="float64"), 1, "double")(column)


def pair_fingerprint(before, after):  # noqa: ANN001, ANN201
    """One hash of both texts' tree fingerprints."""
    return _typed(lambda a, b: pd.Series([_digest(tree_print(x) + "\0" + tree_print(y)) for x, y in zip(a, b)], dtype=object), 2, "string")(before, after)
