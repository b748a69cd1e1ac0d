"""Validation and review policies as column expressions over the records' structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.safe import safe_value
from sluicebox.functions.text import strip

MIN_TOKENS, MAX_TOKENS, MAX_SHARE, MIN_KEPT = 420, 900, 0.15, 0.75
VERDICT_FLAGS = ("cwe_correct", "fix_correct", "context_correct", "runtime_plausible")


def reasons(*pairs: tuple[Column, str | Column]) -> Column:
    """The messages whose condition holds, in order; a null condition doesn't hold."""
    return F.filter(F.array(*[F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in pairs]), lambda x: x.isNotNull())


def balance_reasons(tokens: Column, positive: Column, negative: Column, share: Column, kept: Column) -> Column:
    """Why a sample isn't window-balanced; the bounds themselves are fine."""
    return reasons(
        (tokens < MIN_TOKENS, "too few tokens"),
        (tokens > MAX_TOKENS, "too many tokens"),
        (positive < 1, "no positive window"),
        (negative < 1, "no negative window"),
        (share > F.lit(MAX_SHARE), "parts cover too much"),
        (kept < F.lit(MIN_KEPT), "fix keeps too little"),
    )


def tool_status(code: Column, body: Column, key: str, state: Column) -> Column:
    """success, or error for no JSON, no list under the key, or an exit code other than 0 and 1; a run that didn't complete keeps its state."""
    parsed = F.get_json_object(body, f"$.{key}")
    listed = F.coalesce(parsed.startswith("["), F.lit(False))
    return F.when(state != "completed", state).when(~listed | ~code.isin(0, 1), "error").otherwise("success")


def availability_message(label: str, before: Column, after: Column, error: Column) -> Column:
    """Null where both runs succeeded; else what kept the tool from working: missing beats timeout beats the last error line."""
    either = lambda s: (before == s) | (after == s)
    line = F.substring(F.element_at(F.split(strip(error), "\r\n|\r|\n", -1), -1), 1, 240)
    failed = F.concat(F.lit(f"{label} failed to run"), F.coalesce(F.concat(F.lit(": "), F.nullif(line, F.lit(""))), F.lit("")))
    return F.when((before == "success") & (after == "success"), F.lit(None)).when(either("missing"), f"{label} is not available").when(either("timeout"), f"{label} timed out").otherwise(failed)


def _named(message: str, ids: Column) -> Column:
    return F.concat(F.lit(f"{message}: "), F.array_join(ids, ", "))


def lint_verdict(expected: Column, before: Column, after: Column, ran: Column) -> Column:
    """struct(warnings, reasons): expected ids not found before the fix are a warning, found after it a reason; both name them."""
    on = ran & (F.size(expected) > 0)
    left = F.array_sort(F.array_intersect(after, expected))
    return F.struct(
        reasons((on & ~F.arrays_overlap(before, expected), _named("expected lint ids not reported before the fix", expected))).alias("warnings"),
        reasons((on & (F.size(left) > 0), _named("expected lint ids still reported after the fix", left))).alias("reasons"),
    )


def rule_verdict(mode: Column, expected: Column, known: Column, before: Column, after: Column, ran: Column, structural: Column) -> Column:
    """struct(warnings, reasons): missing before, left after, and rules of other classes after the fix, each with the ids.

    An xss fix that passed the structural checks may keep its helper finding, alone: a warning.
    """
    on = ran & (F.size(expected) > 0)
    left = F.array_sort(F.array_intersect(after, expected))
    helper = (mode == "xss") & (F.size(left) == 1) & F.exists(left, lambda x: x.endswith("xss-helper")) & structural
    other = F.array_sort(F.array_except(F.array_intersect(after, known), expected))
    return F.struct(
        reasons((on & helper, "helper finding left after a verified fix")).alias("warnings"),
        reasons(
            (on & ~F.arrays_overlap(before, expected), _named("expected rules not reported before the fix", expected)),
            (on & ~helper & (F.size(left) > 0), _named("expected rules still reported after the fix", left)),
            (on & (F.size(other) > 0), _named("rules of other classes reported after the fix", other)),
        ).alias("reasons"),
    )


VERDICTS = ["pass", "fail", "unsure"]
REASON_CATEGORIES = ["none", "wrong_cwe", "incomplete_fix", "wrong_context", "runtime_issue", "other"]


def review_consistent(review: Column) -> Column:
    """A known verdict and category and four truth values; pass goes with all true and none, any other verdict with a category that isn't none."""
    flags = [review[f] for f in VERDICT_FLAGS]
    known = review["verdict"].isin(VERDICTS) & review["reason_category"].isin(REASON_CATEGORIES) & F.forall(F.array(*flags), lambda x: x.isNotNull())
    clean = review["reason_category"] == "none"
    fits = F.when(review["verdict"] == "pass", F.forall(F.array(*flags), lambda x: x) & clean).otherwise(~clean)
    return F.coalesce(known & fits, F.lit(False))


def parse_review(reply: Column) -> Column:
    """The review of a reply's JSON object; null unless it has exactly the six fields, truth values where they belong, and is consistent."""
    v = F.try_parse_json(reply)
    get = lambda f, t: F.try_variant_get(v, f"$.{f}", t)
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    typed = F.lit(True)
    for f in VERDICT_FLAGS:
        typed = typed & F.coalesce(kind(f) == "BOOLEAN", F.lit(False))
    for f in ("verdict", "reason_category"):
        typed = typed & F.coalesce(kind(f) == "STRING", F.lit(False))
    keys = F.array_sort(F.json_object_keys(reply))
    exact = F.coalesce(keys == F.array(*map(F.lit, sorted([*VERDICT_FLAGS, "verdict", "reason_category"]))), F.lit(False))
    review = F.struct(get("verdict", "string").alias("verdict"), *[get(f, "boolean").alias(f) for f in VERDICT_FLAGS], get("reason_category", "string").alias("reason_category"))
    return F.when(exact & typed & review_consistent(review), review)


def review_passed(review: Column) -> Column:
    flags = [F.coalesce(review[f], F.lit(False)) for f in VERDICT_FLAGS]
    done = (review["status"] == "completed") & (review["verdict"] == "pass") & (review["reason_category"] == "none")
    return F.coalesce(done, F.lit(False)) & flags[0] & flags[1] & flags[2] & flags[3]


def rejection_category(check: Column, required: Column, status: Column, verdict: Column, validated: Column, why: Column) -> Column:
    """The first that fits: diversity, reviewer, generation, export parts, analyzer, structural validation.

    Any reason that holds the word "tool" counts as the analyzer's.
    """
    text = F.lower(F.array_join(why, " "))
    has = lambda *xs: F.coalesce(F.exists(F.array(*map(F.lit, xs)), lambda x: F.contains(text, x)), F.lit(False))
    review = F.coalesce(required, F.lit(False)) & F.coalesce((status == "error") | ((status == "completed") & ~verdict.eqNullSafe("pass")), F.lit(False))
    return (
        F.when(F.coalesce(check, F.lit("")) != "", "diversity")
        .when(review, "reviewer")
        .when(~F.coalesce(validated, F.lit(False)), "generation")
        .when(has("badparts", "goodparts"), "export_parts")
        .when(has("bandit", "semgrep", "tool"), "analyzer_tool")
        .otherwise("structural_validation")
    )


def revalidation_category(reason: Column) -> Column:
    r = F.lower(reason)
    return (
        F.when(F.contains(r, F.lit("other classes")) | F.contains(r, F.lit("rules still report")), "post_fix_rules")
        .when(F.contains(r, F.lit("path-safe containment")), "path_containment")
        .when(F.contains(r, F.lit("reviewer")), "review")
        .when(F.contains(r, F.lit("could not be reconstructed")), "record_schema")
        .otherwise("validation")
    )


def review_summary(rows: DataFrame, keys: list[str], review: str) -> DataFrame:
    """Counts per key: required, passed, failed, skipped (not required), legacy_missing (no review)."""
    r = F.col(review)
    need = r.isNotNull() & F.coalesce(r["required"], F.lit(False))
    return rows.groupBy(*keys).agg(
        F.count_if(need).alias("required"), F.count_if(need & review_passed(r)).alias("passed"), F.count_if(need & ~review_passed(r)).alias("failed"),
        F.count_if(r.isNotNull() & ~need).alias("skipped"), F.count_if(r.isNull()).alias("legacy_missing"),
    )


def status_counts(rows: DataFrame, review: str) -> DataFrame:
    """``field, value, n``: safe values of the required reviews' fields."""
    r = F.col(review)
    fields = ("status", "verdict", "reason_category", "provider")
    need = rows.where(r.isNotNull() & F.coalesce(r["required"], F.lit(False)))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), safe_value(r[f]).alias("value")) for f in fields])).alias("p")
    return need.select(pairs).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def slot_outcomes(attempts: DataFrame) -> DataFrame:
    """``slot, attempts, accepted_attempt``: the first accepted attempt of each slot; null where none was."""
    first = F.min(F.when(F.coalesce("accepted", F.lit(False)), F.col("attempt")))
    return attempts.groupBy("slot").agg(F.count("*").alias("attempts"), first.alias("accepted_attempt"))
