"""The weakness classes: the one dimension table, and what the planner may combine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: key, CWE, name, short rule ids, lint ids.
CLASSES = [
    ("sql", "CWE-89", "SQL Injection", ["cwe-89.sql-injection"], ["B608"]),
    ("command_injection", "CWE-78", "Command Injection", ["cwe-78.command-injection"], ["B602", "B605"]),
    ("directory_traversal", "CWE-22", "Path Traversal", ["cwe-22.path-traversal"], []),
    ("open_redirect", "CWE-601", "Open Redirect", ["cwe-601.open-redirect"], []),
    ("remote_code_execution", "CWE-94", "Remote Code Execution", ["cwe-94.remote-code-execution"], ["B307", "B102"]),
    ("xss", "CWE-79", "Cross-Site Scripting", ["cwe-79.xss", "cwe-79.xss-helper"], ["B703"]),
    ("xsrf", "CWE-352", "Cross-Site Request Forgery", ["cwe-352.csrf-disabled"], []),
]
MODES = [c[0] for c in CLASSES]
APPS = ["Flask", "Django", "CLI", "API", "script"]
APPS_OF = {
    "sql": ["Flask", "Django", "API", "script"],
    "directory_traversal": ["Flask", "API", "CLI", "script"],
    "open_redirect": ["Flask", "Django", "API"],
    "xss": ["Flask", "Django", "API"],
    "xsrf": ["Flask"],
}
LEVELS = ["easy", "medium", "hard"]
FLOWS_OF = {"single_function": ["direct"], "class_based": ["direct", "indirect", "complex"], "multi_function": ["indirect", "complex"]}
#: Field order of the planner's greedy choice; the balanced selection has difficulty before structure.
FIELDS = ["application_type", "flow_pattern", "structure", "difficulty"]


def shapes(profile: str = "compact") -> list[str]:
    """Program shapes of a profile: a long, window-balanced sample is never a single function."""
    return [s for s in FLOWS_OF if profile == "compact" or s != "single_function"]


def compatible(mode: str, profile: str = "compact") -> list[tuple[str, str, str, str]]:
    """All achievable (application, flow, structure, difficulty) of a class."""
    apps = APPS_OF.get(mode, APPS)
    return [(a, f, s, d) for a in apps for s in shapes(profile) for d in LEVELS for f in FLOWS_OF[s]]


def dimension(spark: SparkSession, prefix: str = "rules") -> DataFrame:
    """``mode, cwe, cwe_name, rule_ids, lint_ids, pos``: 7 rows. Rule ids get the prefix of the scanner's rule set."""
    rows = [(k, c, n, [f"{prefix}.{r}" for r in rules], lints, i) for i, (k, c, n, rules, lints) in enumerate(CLASSES)]
    return spark.createDataFrame(rows, "mode string, cwe string, cwe_name string, rule_ids array<string>, lint_ids array<string>, pos int")


def aliases(spark: SparkSession) -> DataFrame:
    """``alias, mode``: key, mode and CWE of each class in lower case, for lookups by any of them."""
    rows = sorted({(x, k) for k, c, *_ in CLASSES for x in (k, c.lower())})
    return spark.createDataFrame(rows, "alias string, mode string")


def tuples(spark: SparkSession, profile: str = "compact") -> DataFrame:
    rows = [(m, *t) for m in MODES for t in compatible(m, profile)]
    return spark.createDataFrame(rows, "mode string, " + ", ".join(f"{f} string" for f in FIELDS))
