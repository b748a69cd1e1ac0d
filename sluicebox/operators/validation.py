"""The verdict on a code pair: parts, structure, window balance and tool runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.functions import rules
from sluicebox.functions.pycode import round_binary
from sluicebox.functions.registry import CLASSES
from sluicebox.functions.safe import fold_profile, rule_id
from sluicebox.functions.scan import scan
from sluicebox.functions.text import STRIDE, WINDOW, let, part_token_count, tokens, window_labels
from sluicebox.operators.policy import availability_message, balance_reasons, lint_verdict, rule_verdict
from sluicebox.operators.schemas import VALIDATION
from sluicebox.operators.tools import OLD_RUN, TOOL_RUN as TOOL_RUN, tool_run

PREFIX = "rules"
OLD_RUNS = f"STRUCT<bandit: {OLD_RUN}, semgrep: {OLD_RUN}>"


def known_rules(prefix: str = PREFIX) -> list[str]:
    return [f"{prefix}.{r}" for c in CLASSES for r in c[3]]


def split_findings(findings: Column, file: Column, keys: tuple[str, ...] = ("filename", "path")) -> Column:
    """The findings of one file of a run over several: by its path, or by the last part of it."""
    last = lambda p: F.element_at(F.split(p, "/", -1), -1)
    hit = lambda x: F.exists(F.array(*[x[k] for k in keys]), lambda p: F.coalesce((p != "") & ((p == file) | (last(p) == last(file))), F.lit(False)))
    return F.filter(findings, hit)


def lint_ids(run: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(run["findings"], lambda x: x["test_id"]), lambda x: F.coalesce(x != "", F.lit(False))))


def scan_ids(run: Column, prefix: str = PREFIX) -> Column:
    """Rule ids as they are, and from the rule set's name on."""
    ids = F.filter(F.transform(run["findings"], lambda x: x["check_id"]), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.array_distinct(F.concat(ids, F.transform(ids, lambda x: rule_id(x, prefix))))


def balance(before: Column, after: Column, parts: Column) -> Column:
    """The window balance of a pair, ratios rounded to 6 digits."""

    def of(t: Column, fixed: Column, hit: Column, y: Column) -> Column:
        ones = F.aggregate(y, F.lit(0), lambda s, x: s + x)
        return F.struct(F.lit(WINDOW).alias("window_size"), F.lit(STRIDE).alias("stride"), t.alias("vulnerable_token_count"), fixed.alias("fixed_token_count"), ones.alias("positive_window_count"), (F.size(y) - ones).alias("negative_window_count"), hit.alias("badpart_token_count"))

    return let(F.size(tokens(before)), lambda t: let(F.size(tokens(after)), lambda f: let(part_token_count(before, parts), lambda h: let(window_labels(before, parts), lambda y: of(t, f, h, y)))))


def with_balance(records: DataFrame, name: str = "window_balance") -> DataFrame:
    """The records with their window balance; null for profiles that don't ask for one."""
    asked = fold_profile(F.coalesce("generation_profile", F.col("context")["generation_profile"]), "compact") == "window_balanced"
    rows = records.withColumn(name, F.when(asked, balance(F.col("vulnerable_code"), F.col("fixed_code"), F.col("badparts"))))
    b = F.col(name)
    ratio = lambda part: round_binary(F.when(b["vulnerable_token_count"] > 0, b[part] / b["vulnerable_token_count"]).when(b.isNotNull(), F.lit(0.0)))
    rows = rows.withColumn("_share", ratio("badpart_token_count")).withColumn("_kept", ratio("fixed_token_count"))
    whole = F.struct(f"{name}.*", F.col("_share").alias("badpart_token_ratio"), F.col("_kept").alias("fixed_token_retention"))
    return rows.withColumn(name, F.when(b.isNotNull(), whole)).drop("_share", "_kept")


def with_scans(records: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """The records with the rule set's own findings as the scanner's runs before and after, where the record has none."""
    found = lambda ids, file: F.transform(ids, lambda x: F.struct(F.lit(None).cast("string").alias("test_id"), x.alias("check_id"), F.lit(file).alias("filename"), F.lit(file).alias("path")))
    none = F.lit(None).cast("string")
    rows = records.withColumns({"_b": scan(F.coalesce("vulnerable_code", F.lit("")), prefix), "_a": scan(F.coalesce("fixed_code", F.lit("")), prefix)})
    v = F.coalesce("validation", F.from_json(F.lit("{}"), VALIDATION))
    for phase, ids, file in (("before", "_b", "before.py"), ("after", "_a", "after.py")):
        own = F.struct(F.lit("rules").alias("name"), F.lit(True).alias("available"), F.lit("success").alias("status"), F.array().cast("array<string>").alias("command"), F.lit(0).alias("returncode"), found(F.col(ids), file).alias("findings"), none.alias("error"))
        v = v.withField(f"semgrep_{phase}", F.coalesce(tool_run(F.col("validation"), "semgrep", phase), own.cast(TOOL_RUN)))
    return rows.withColumn("validation", v).select(*records.columns)


def validate(records: DataFrame, strict: bool = False, prefix: str = PREFIX) -> DataFrame:
    """The records with a new ``validation``: whether no reason speaks against them, the reasons in order, warnings, structure and balance.

    Tool runs are input: ``bandit_before, bandit_after, semgrep_before, semgrep_after`` of the old
    validation (a missing run is an unavailable tool). An unavailable tool is a warning, or a
    reason where ``strict``. Nulls count as empty texts and lists.
    """
    none = F.array().cast("array<string>")
    old = F.col("validation")
    rows = records.withColumns({c: F.coalesce(c, F.lit("")) for c in ("vulnerable_code", "fixed_code")}).withColumns({c: F.coalesce(c, none) for c in ("badparts", "goodparts")})
    rows = rows.withColumn("_seen", rules.facts(F.col("vulnerable_code"))).withColumn("_fixed", rules.facts(F.col("fixed_code")))
    ctx = F.col("context")
    why = rules.structural_reasons(F.col("mode"), ctx["application_type"], ctx["flow_pattern"], ctx["structure"], F.col("vulnerable_code"), F.col("fixed_code"), F.col("_seen"), F.col("_fixed"))
    rows = with_balance(rows.withColumn("_why", why), "_balance")
    b = F.col("_balance")
    uneven = F.when(b.isNotNull(), balance_reasons(b["vulnerable_token_count"], b["positive_window_count"], b["negative_window_count"], b["badpart_token_ratio"], b["fixed_token_retention"])).otherwise(none)
    absent = [F.filter(F.array(F.when(F.size(c) == 0, F.lit(m))), lambda x: x.isNotNull()) for c, m in (("badparts", "no parts of the code before, badparts, to export"), ("goodparts", "no parts of the code after, goodparts, to export"))]
    runs = {k: tool_run(old, *k.split("_")) for k in ("bandit_before", "bandit_after", "semgrep_before", "semgrep_after")}
    said = {k: F.when(F.coalesce(r["available"], F.lit(False)), "success").otherwise(F.coalesce(r["status"], F.lit("missing"))) for k, r in runs.items()}
    away = {t: availability_message(t, said[f"{t}_before"], said[f"{t}_after"], F.coalesce(F.nullif(runs[f"{t}_before"]["error"], F.lit("")), runs[f"{t}_after"]["error"])) for t in ("bandit", "semgrep")}
    missing = F.filter(F.array(*away.values()), lambda x: x.isNotNull())
    by_class = lambda i, p="": F.coalesce(F.element_at(F.create_map(*[x for c in CLASSES for x in (F.lit(c[0]), F.array(*[F.lit(p + r) for r in c[i]]).cast("array<string>"))]), F.col("mode")), none)
    ran = lambda t: F.coalesce(runs[f"{t}_before"]["available"], F.lit(False))
    ids = lambda f, r: F.coalesce(f(r), none)
    lint = lint_verdict(by_class(4), ids(lint_ids, runs["bandit_before"]), ids(lint_ids, runs["bandit_after"]), ran("bandit"))
    every = F.array(*map(F.lit, known_rules(prefix)))
    scan = rule_verdict(F.col("mode"), by_class(3, f"{prefix}."), every, ids(scan_ids, runs["semgrep_before"]), ids(scan_ids, runs["semgrep_after"]), ran("semgrep"), F.size("_why") == 0)
    rows = rows.withColumns({"_lint": lint, "_scan": scan})
    reasons = F.concat(*absent, F.col("_why"), uneven, missing if strict else none, F.col("_lint.reasons"), F.col("_scan.reasons"))
    warnings = F.concat(none if strict else missing, F.col("_lint.warnings"), F.col("_scan.warnings"))
    structural = F.struct((F.size("_why") == 0).alias("passed"), F.col("_why").alias("reasons"), none.alias("vulnerable_markers"), none.alias("fixed_markers"))
    verdict = F.struct((F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"), warnings.alias("warnings"), structural.alias("structural"), *[r.alias(k) for k, r in runs.items()], F.lit(None).cast(OLD_RUNS).alias("tool_results"), b.alias("window_balance"))
    return rows.withColumn("validation", verdict).select(*records.columns)
