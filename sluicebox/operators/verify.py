"""Final verification: long-form summaries of accepted and rejected records, and the issues that fail a dataset.

A summary is rows ``section, key, value`` with counts; :func:`report` nests them for the sink.
Issues are rows ``stage, code, sample_id, mode``; a dataset passes if there are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.functions import pycode, text
from sluicebox.functions.registry import FIELDS, MODES, dimension
from sluicebox.functions.safe import safe_value, truthy
from sluicebox.operators import dedup, policy, reports
from sluicebox.operators.export import broken_links, commit_lines, exported, sidecar
from sluicebox.operators.tools import run_status, tool_run
from sluicebox.operators.validation import PREFIX, known_rules, scan_ids

STAGES = ["input", "duplicates", "validation", "review", "integrity"]
REVIEW_FIELDS = ("status", "verdict", "reason_category", "provider")
_FLAGS = policy.VERDICT_FLAGS


def mode_of() -> Column:
    c = F.col("context")
    return safe_value(F.coalesce(F.nullif(F.col("mode"), F.lit("")), F.nullif(c["mode"], F.lit("")), c["cwe_key"]))


def profile_of() -> Column:
    return safe_value(truthy(F.coalesce(F.nullif(F.col("generation_profile"), F.lit("")), F.col("context")["generation_profile"]), "compact"))


def _counted(rows: DataFrame, entries: list[Column]) -> DataFrame:
    """``section, key, value`` of the rows' entries (null ones aside), in one pass."""
    pairs = F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("e")
    return rows.select(pairs).groupBy("e.section", "e.key").agg(F.sum("e.n").alias("value"))


def _entry(section: str | Column, key: str | Column, when: Column | None = None, n: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    row = F.struct(lit(section).alias("section"), lit(key).alias("key"), (F.lit(1) if n is None else n).cast("bigint").alias("n"))
    return row if when is None else F.when(when, row)


def _context() -> list[Column]:
    return [safe_value(F.col("context")[f]) for f in FIELDS]


def coverage_summary(accepted: DataFrame) -> DataFrame:
    """Per mode: records, each context field's values, whole contexts. Known modes without records have a 0."""
    values = _context()
    m = mode_of()
    out = _counted(accepted, [_entry("accepted", m), *[_entry(F.concat(m, F.lit(f".{f}")), v) for f, v in zip(FIELDS, values)], _entry(F.concat(m, F.lit(".contexts")), F.concat_ws("|", *values)), _entry("total", "accepted")])
    zero = dimension(accepted.sparkSession).select(F.lit("accepted").alias("section"), F.col("mode").alias("key"), F.lit(0).cast("bigint").alias("value"))
    return out.unionByName(zero).groupBy("section", "key").agg(F.sum("value").alias("value"))


def duplicate_decisions(accepted: DataFrame, pinned: str | None = None) -> DataFrame:
    """The duplicate policy over records ``ord, id, cwe, mode, vulnerable_code, fixed_code``, decided in the order of ord."""
    v, f = (F.coalesce(c, F.lit("")) for c in ("vulnerable_code", "fixed_code"))
    bucket = F.coalesce(F.nullif(F.col("cwe"), F.lit("")), F.nullif(F.col("mode"), F.lit("")), F.lit("unknown"))
    prints = accepted.select("ord", "id", bucket.alias("bucket"), *([pinned] if pinned else []), text.pair_hash(v, f).alias("pair_hash"), pycode.pair_fingerprint(v, f).alias("tree"), pycode.code_tokens(v).alias("t"), pycode.code_tokens(f).alias("u"))
    rows = prints.withColumn("items", text.shingles(text.pair_tokens(F.col("t"), F.col("u")))).withColumn("name", F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col("pair_hash")))
    return dedup.duplicate_policy(rows, "pair_hash", "tree", "bucket", "items", pinned=pinned, name="name")


def duplicate_summary(decisions: DataFrame) -> DataFrame:
    """Checked rows and, for each check in policy order, the count; rates are for the sink."""
    counts = _counted(decisions, [_entry("duplicates", "checked"), _entry("duplicates", F.col("check"), ~F.col("accepted"))])
    zero = decisions.sparkSession.createDataFrame([("duplicates", c, 0) for c in ("checked", *dedup.CHECKS)], "section string, key string, value bigint")
    return counts.unionByName(zero).groupBy("section", "key").agg(F.sum("value").alias("value"))


def _post_fix() -> Column:
    """Distinct known rules reported after the fix; an xss helper alone is excused by passed structural checks."""
    v = F.col("validation")
    found = F.array_sort(F.array_intersect(F.coalesce(scan_ids(tool_run(v, "semgrep", "after")), F.array().cast("array<string>")), F.array(*map(F.lit, known_rules()))))
    excused = (mode_of() == "xss") & (found == F.array(F.lit(f"{PREFIX}.cwe-79.xss-helper"))) & F.coalesce(v["structural"]["passed"], F.lit(False))
    return F.when(v.isNull() | excused, F.array().cast("array<string>")).otherwise(found)


def validation_summary(accepted: DataFrame) -> DataFrame:
    """Three states of the verdict and the structure, warnings, tools by phase and status, rules left after the fix."""
    v = F.col("validation")
    here = v.isNotNull()
    ok = F.coalesce(v["passed"], F.lit(False))
    s = v["structural"]
    warned = F.coalesce(F.size(v["warnings"]), F.lit(0))
    entries = [
        _entry("validation", F.when(~here, "missing").when(ok, "passed").otherwise("failed")), _entry("structural", F.when(~here | s.isNull(), "missing").when(F.coalesce(s["passed"], F.lit(False)), "passed").otherwise("failed")),
        _entry("warnings", "records", here & (warned > 0)), _entry("warnings", "count", here & (warned > 0), warned),
        *[_entry(f"tools.{t}.{p}", run_status(tool_run(v, t, p)), here) for t in ("bandit", "semgrep") for p in ("before", "after")],
    ]
    rules = accepted.select(F.explode(_post_fix()).alias("key")).groupBy("key").agg(F.count("*").alias("value")).select(F.lit("post_fix_rules").alias("section"), "key", "value")
    return _counted(accepted, entries).unionByName(rules)


def review_summary(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Accepted: required, passed, failed, skipped, legacy_missing and the required reviews' values; rejected: the same values of required reviews that ran."""
    r = F.col("review")
    need = r.isNotNull() & F.coalesce(r["required"], F.lit(False))
    ran = need & (safe_value(r["status"]) != "not_run")
    ok = _passed(r)
    state = F.when(r.isNull(), "legacy_missing").when(~need, "skipped").when(ok, "passed").otherwise("failed")
    one = _counted(accepted, [_entry("review.accepted", state), _entry("review.accepted", "required", need), *[_entry(f"review.accepted.{f}", safe_value(r[f]), need) for f in REVIEW_FIELDS]])
    two = _counted(rejected, [_entry("review.rejected", F.when(ran, "total").otherwise("not_run"), need), *[_entry(f"review.rejected.{f}", safe_value(r[f]), ran) for f in REVIEW_FIELDS]])
    return one.unionByName(two)


def _passed(r: Column) -> Column:
    done = (safe_value(r["status"]) == "completed") & (safe_value(r["verdict"]) == "pass") & (safe_value(r["reason_category"]) == "none")
    for f in _FLAGS:
        done = done & F.coalesce(r[f], F.lit(False))
    return F.coalesce(done, F.lit(False))


def record_category() -> Column:
    """The category of a rejected record; the reasons are those of its validation, else its own."""
    v, r = F.col("validation"), F.col("review")
    check = F.col("diversity_rejection")["check"]
    return policy.rejection_category(check, r["required"], r["status"], r["verdict"], v.isNotNull(), F.coalesce(v["reasons"], F.col("reject_reason"), F.array().cast("array<string>")))


def rejection_summary(rejected: DataFrame) -> DataFrame:
    """Counts by mode, category, context field and whole context; checks for duplicates only."""
    values = _context()
    check = safe_value(F.col("diversity_rejection")["check"])
    known = F.when(check.isin(*dedup.CHECKS), check).otherwise("unknown")
    c = F.col("_category")
    entries = [_entry("rejected", "total"), _entry("rejected.by_mode", mode_of()), _entry("rejected.by_category", c), _entry("rejected.checks", known, c == "diversity"), *[_entry(f"rejected.{f}", x) for f, x in zip(FIELDS, values)], _entry("rejected.contexts", F.concat_ws("|", *values))]
    return _counted(rejected.withColumn("_category", record_category()), entries)


def diversity_summary(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Marginals of the accepted records, and the rejections by check."""
    kept = records.join(decisions.where("accepted").select("ord"), "ord", "left_semi")
    c = F.col("context")
    fields = [("cwe", F.col("cwe")), *[(f, c[f]) for f in ("application_type", "flow_pattern", "difficulty", "structure")]]
    marginals = _counted(kept, [_entry("diversity", "total"), *[_entry(f"diversity.{f}", truthy(x.cast("string"), "unknown")) for f, x in fields]])
    return marginals.unionByName(_counted(decisions, [_entry("diversity.rejections", F.col("check"), ~F.col("accepted"))]))


# --- issues ---------------------------------------------------------------------------------------------


def issue(rows: DataFrame, stage: str, code: str | Column, sample_id: Column | None = None, mode: Column | None = None) -> DataFrame:
    """``stage, code, sample_id, mode``; unsafe or unknown ids and modes are left out."""
    known = lambda c: F.nullif(safe_value(c), F.lit("unknown")) if c is not None else F.lit(None).cast("string")
    return rows.select(F.lit(stage).alias("stage"), (F.lit(code) if isinstance(code, str) else code).alias("code"), known(sample_id).alias("sample_id"), known(mode).alias("mode"))


def record_issues(accepted: DataFrame) -> DataFrame:
    """The issues of validation and review, several a record."""
    v, r = F.col("validation"), F.col("review")
    s = v["structural"]
    here = v.isNotNull()
    need = r.isNotNull() & F.coalesce(r["required"], F.lit(False))
    checks = [
        ("validation", "missing_validation", ~here),
        ("validation", "missing_window_balance_validation", here & (profile_of() == "window_balanced") & v["window_balance"].isNull()),
        ("validation", "failed_validation", here & ~F.coalesce(v["passed"], F.lit(False))),
        ("validation", "missing_structural_validation", here & s.isNull()),
        ("validation", "failed_structural_validation", here & s.isNotNull() & ~F.coalesce(s["passed"], F.lit(False))),
        ("validation", "post_fix_rule_finding", F.size(_post_fix()) > 0),
        ("review", "review_not_passed", need & ~_passed(r)),
    ]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(a).alias("stage"), F.lit(b).alias("code"))) for a, b, c in checks]), lambda x: x.isNotNull())
    known = lambda c: F.nullif(safe_value(c), F.lit("unknown"))
    return accepted.select(F.explode(found).alias("x"), known(F.col("id")).alias("sample_id"), known(mode_of()).alias("mode")).select("x.stage", "x.code", "sample_id", "mode")


def integrity_issues(accepted: DataFrame, plain: DataFrame, side: DataFrame, files: list[str] | None = None) -> DataFrame:
    """The issues of an export: repeated ids, modes that aren't known, commits that differ, rows of the sidecar that differ or point nowhere.

    ``plain`` is what stands in the layout, ``mode, repo, commit_id, filename, json``; ``side`` the
    sidecar's rows ``mode, row_index, repo, commit_id, filename, json``; ``files`` the names found.
    """
    rows = exported(accepted)
    ids = reports.duplicate_ids(accepted.select(safe_value(F.col("id")).alias("id")), "id")
    out = issue(ids, "integrity", "duplicate_accepted_id", F.col("id"))
    odd = rows.where(~F.col("mode").isin(MODES)).select("mode").distinct()
    out = out.unionByName(issue(odd, "integrity", "unknown_export_mode", mode=F.col("mode")))
    keys = ["mode", "repo", "commit_id"]
    want = commit_lines(rows)
    diff = reports.difference(want.where(F.col("mode").isin(MODES)), plain.where(F.col("mode").isin(MODES)), keys, F.col("json"))
    out = out.unionByName(issue(diff.select("mode").distinct(), "integrity", "plain_payload_mismatch", mode=F.col("mode")))
    extra = reports.difference(sidecar(accepted), side, ["mode", "row_index"], F.col("json")).limit(1)
    out = out.unionByName(issue(extra, "integrity", "metadata_payload_mismatch"))
    lost = broken_links(side.select("mode", "repo", "commit_id", "filename", F.get_json_object("json", "$.id").alias("id")), plain)
    out = out.unionByName(issue(lost, "integrity", "sidecar_link_missing", F.col("id"), F.col("mode")))
    if files is not None:
        wanted = {f"plain_{m}" for m in MODES}
        names = [("unexpected_plain_file", f.removeprefix("plain_")) for f in files if f.startswith("plain_") and f not in wanted] + [("plain_file_missing", f.removeprefix("plain_")) for f in sorted(wanted - set(files))]
        names += [] if "metadata.jsonl" in files else [("metadata_missing", None)]
        found = accepted.sparkSession.createDataFrame(names, "code string, mode string")
        out = out.unionByName(issue(found, "integrity", F.col("code"), mode=F.col("mode")))
    return out


def duplicate_issues(accepted: DataFrame, decisions: DataFrame) -> DataFrame:
    bad = accepted.join(decisions.where("not accepted").select("ord"), "ord", "left_semi")
    return issue(bad, "duplicates", "accepted_duplicate", F.col("id"), mode_of())


def export_counts(accepted: DataFrame) -> DataFrame:
    """``mode, commits``: commits of each known mode, a repeated id once."""
    rows = exported(accepted).groupBy("mode").agg(F.count("*").alias("n"))  # a row per commit
    return dimension(accepted.sparkSession).select("mode").join(rows, "mode", "left").select("mode", F.coalesce("n", F.lit(0)).alias("commits"))


def summaries(accepted: DataFrame, rejected: DataFrame, decisions: DataFrame) -> DataFrame:
    parts = [coverage_summary(accepted), duplicate_summary(decisions), validation_summary(accepted), review_summary(accepted, rejected), rejection_summary(rejected)]
    parts.append(export_counts(accepted).select(F.lit("export").alias("section"), F.col("mode").alias("key"), F.col("commits").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verify(accepted: DataFrame, rejected: DataFrame, plain: DataFrame, side: DataFrame, files: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The summaries and the issues of a dataset and its export. Issues come in the order of STAGES when sorted by it."""
    decisions = duplicate_decisions(accepted)
    issues = duplicate_issues(accepted, decisions).unionByName(record_issues(accepted)).unionByName(integrity_issues(accepted, plain, side, files))
    return summaries(accepted, rejected, decisions), issues


def report(summary: DataFrame, issues: DataFrame) -> dict:
    """A nested report for the JSON sink: counts by section, rates of duplicates by binary rounding, the issues, and the status."""
    out: dict = {}
    for r in summary.orderBy("section", "key").toLocalIterator():  # counters: their number follows the classes and contexts
        out.setdefault(r["section"], {})[r["key"]] = r["value"]
    total = out.get("duplicates", {}).get("checked", 0)
    out["duplicate_rates"] = {c: round(out["duplicates"].get(c, 0) / total, 6) if total else 0.0 for c in dedup.CHECKS}
    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    found = [{k: v for k, v in r.asDict().items() if v is not None and k != "stage"} for r in issues.orderBy(rank, "sample_id", "code", "mode").toLocalIterator()]
    return {"schema_version": 1, "status": "fail" if found else "pass", "error_count": len(found), "errors": found} | out

