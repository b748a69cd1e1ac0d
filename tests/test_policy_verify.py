from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluicebox.operators import candidates, export, policy, revalidation, validation, verify
from sluicebox.operators.policy import VERDICT_FLAGS
from sluicebox.sources import files
from sluicebox.sources.small import read_text

BEFORE = "from flask import Flask, request\napp = Flask(__name__)\n@app.get('/u')\ndef user():\n    name = request.args.get('n')\n    cursor.execute(f\"SELECT * FROM users WHERE n = '{name}'\")\n"
AFTER = BEFORE.replace("cursor.execute(f\"SELECT * FROM users WHERE n = '{name}'\")", "cursor.execute('SELECT * FROM users WHERE n = ?', (name,))")
REVIEW = {"required": True, "status": "completed", "verdict": "pass", "reason_category": "none", "provider": "mock", **dict.fromkeys(VERDICT_FLAGS, True)}
OK = {"available": True, "status": "success", "findings": []}
TOOLS = {"bandit_before": {**OK, "findings": [{"test_id": "B608"}]}, "bandit_after": OK, "semgrep_before": {**OK, "findings": [{"check_id": "lib.rules.cwe-89.sql-injection"}]}, "semgrep_after": OK}


def tail(n):
    """Code of its own for each record, so that none is near another."""
    rng = random.Random(n)
    return "LIMIT = a" + "".join(f" {rng.choice(['-', '*', '//', '<<', '|', '&'])} {rng.choice(['a', '1'])}" for _ in range(40)) + "\n"


def record(n, **more):
    row = {
        "ord": n, "id": f"CWE-89_sql_{n:06d}", "cwe": "CWE-89", "cwe_name": "SQL Injection", "mode": "sql", "commit_message": "Bind values", "filename": "app.py", "vulnerable_code": BEFORE + tail(n), "fixed_code": AFTER + tail(n),
        "diff": "-a\n+b", "badparts": ["cursor.execute(f"], "goodparts": ["cursor.execute('"], "provider": "mock",
        "context": {"cwe_key": "sql", "mode": "sql", "application_type": "Flask", "flow_pattern": "direct", "difficulty": "easy", "structure": "single_function", "sample_index": n},
        "validation": {"passed": True, "reasons": [], "warnings": [], "structural": {"passed": True}, **TOOLS}, "review": REVIEW,
    }
    return {**row, **more}


@pytest.fixture(scope="session")
def table(spark):
    schema = spark.createDataFrame([], files.RECORD).schema

    def of(*rows):
        text = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
        return text.select(F.from_json("j", schema).alias("r")).select("r.*") if rows else spark.createDataFrame([], schema)

    return of


def report(accepted, rejected, names=None):
    plain, side = export.commit_lines(export.exported(accepted)), export.sidecar(accepted)
    return verify.report(*verify.verify(accepted, rejected, plain, side, names))


def test_a_sound_dataset_passes(table):
    out = report(table(record(1), record(30)), table())
    assert (out["status"], out["error_count"]) == ("pass", 0)
    assert out["accepted"]["sql"] == 2 and out["accepted"]["xss"] == 0 and out["total"] == {"accepted": 2}
    assert out["sql.contexts"] == {"Flask|direct|single_function|easy": 2} and out["review.accepted"] == {"required": 2, "passed": 2}
    assert out["tools.bandit.before"] == {"success": 2} and out["export"]["sql"] == 2 and out["duplicate_rates"]["near_duplicate"] == 0.0


def test_each_fault_is_an_issue(table):
    xss = {"cwe": "CWE-79", "mode": "xss"}
    helper = {**OK, "findings": [{"check_id": "rules.cwe-79.xss-helper"}]}
    v = record(1)["validation"]
    rows = [
        record(1, validation=None), record(20, validation={**v, "passed": False, "structural": {"passed": False}}), record(40, review={**REVIEW, "fix_correct": False}), record(60, generation_profile="window_balanced"), record(80, validation={**v, "structural": None}),
        record(100, **xss, validation={**v, "semgrep_after": helper}), record(120, **xss, validation={**v, "semgrep_after": helper, "structural": {"passed": False}}), record(140, validation={**v, "warnings": ["w"]}), record(160, review=None), record(180, review={"required": False}),
    ]
    out = report(table(*rows), table())
    codes = [(e["code"], e["sample_id"][-3:]) for e in out["errors"]]
    assert codes == [
        ("missing_validation", "001"), ("failed_structural_validation", "020"), ("failed_validation", "020"), ("missing_window_balance_validation", "060"), ("missing_structural_validation", "080"), ("failed_structural_validation", "120"), ("post_fix_rule_finding", "120"), ("review_not_passed", "040"),
    ]
    assert out["status"] == "fail" and out["validation"] == {"passed": 8, "failed": 1, "missing": 1} and out["warnings"] == {"records": 1, "count": 1}
    assert out["post_fix_rules"] == {"rules.cwe-79.xss-helper": 1} and out["review.accepted"]["legacy_missing"] == 1 and out["review.accepted"]["skipped"] == 1 and out["review.accepted"]["failed"] == 1


def test_rejections_by_category(table):
    rows = [
        record(1, validation=None, context=None, review=None), record(2, validation={"reasons": ["no path"]}, context=None, review=None), record(3, validation={"reasons": ["Bandit still"]}, context=None, review=None), record(4, validation={"reasons": ["no badparts"]}, context=None, review=None),
        record(5, diversity_rejection={"check": "near_duplicate"}, context=None), record(6, review={**REVIEW, "verdict": "fail", "reason_category": "other"}), record(7, review={**REVIEW, "status": "not_run"}, validation={"reasons": None}, reject_reason=["a tool is missing"]),
    ]
    out = report(table(), table(*rows))
    assert out["rejected.by_category"] == {"generation": 1, "structural_validation": 1, "analyzer_tool": 2, "export_parts": 1, "diversity": 1, "reviewer": 1}
    assert out["rejected.application_type"] == {"Flask": 2, "unknown": 5} and out["rejected.checks"] == {"near_duplicate": 1}
    assert out["review.rejected"] == {"total": 2, "not_run": 1} and out["status"] == "pass"


def test_a_tampered_export_is_found(table):
    rows = table(record(1), record(30), record(50, mode="xss", cwe="CWE-79"), record(70, mode="odd"), record(71, id="CWE-89_sql_000001"))
    plain, side = export.commit_lines(export.exported(rows)), export.sidecar(rows)
    names = [f"plain_{m}" for m in ("sql", "xss", "extra")]
    bad = plain.where("mode <> 'xss'").withColumn("json", F.when(F.col("commit_id").endswith("30"), F.lit("{}")).otherwise(F.col("json")))
    got = sorted(((r.code, r.mode or r.sample_id) for r in verify.integrity_issues(rows, bad, side.where("row_index < 3"), names).collect()), key=str)
    missing = [("plain_file_missing", m) for m in ("command_injection", "directory_traversal", "open_redirect", "remote_code_execution", "xsrf")]
    want = [("duplicate_accepted_id", "CWE-89_sql_000001"), ("metadata_missing", None), ("metadata_payload_mismatch", None), ("plain_payload_mismatch", "sql"), ("plain_payload_mismatch", "xss"), ("sidecar_link_missing", "xss"), ("unexpected_plain_file", "extra"), ("unknown_export_mode", "odd"), *missing]
    assert got == sorted(want, key=str)


def test_export_is_written_and_read_back(spark, table, tmp_path):
    rows = table(record(1), record(2, id=None, diff="see https://x.example", badparts=[], commit_message="api_key=1", filename="/srv/a.py"), record(3, id="CWE-89_sql_000001", commit_message="last"))
    folder = f"file://{tmp_path}/out"
    assert export.write_export(rows, folder)["sql"] == 2
    assert read_text(spark, f"{folder}/plain_xss") == "{}"
    layout = json.loads(read_text(spark, f"{folder}/plain_sql"))["curated/sql"]
    assert layout["CWE-89_sql_000001"]["msg"] == "last" and layout["sample_000002"]["msg"] == "Synthetic security fix"
    change = layout["sample_000002"]["files"]["a.py"]["changes"][0]
    assert change["diff"].startswith("--- a/a.py") and change["badparts"] == ["cursor.execute(f\"SELECT * FROM users WHERE n = '{name}'\")"] and change["remove"] == len(change["badparts"])
    source = layout["sample_000002"]["files"]["a.py"]
    assert source["source"] == "\n" + source["sourceWithComments"] and source["sourceWithComments"].endswith("\n")
    back = files.load_layout(spark, folder).collect()
    assert sorted(r.commit_id for r in back) == ["CWE-89_sql_000001", "sample_000002"] and {r.context.structure for r in back} == {"legacy_unknown"} and {r.dataset for r in back} == {"real"}
    side = [json.loads(r.value) for r in spark.read.text(f"{folder}/metadata.jsonl").collect()]
    assert len(side) == 3 and all(set(x) >= {"id", "cwe", "mode", "plain_file", "row_index", "context", "validation_summary"} for x in side)
    split = export.write_export(rows, f"{folder}2", one_file=10)
    assert split["sql"] == 2 and spark.read.json(f"{folder}2/plain_sql").count() == 2
    assert set(export.write_export(table(), f"{folder}3").values()) == {0} and read_text(spark, f"{folder}3/plain_sql") == "{}"


def test_the_sidecar_shows_only_what_is_allowed(table):
    v = {**record(1)["validation"], "reasons": ["a", "b"], "structural": {"passed": True, "vulnerable_markers": ["ok", "/home/x"]}, "tool_results": {"semgrep": {"status": "timeout", "findings": [{"check_id": "q"}]}}, "semgrep_before": None, "semgrep_after": None, "window_balance": {"window_size": 200, "badpart_token_ratio": 0.0078125, "stride": -1}}
    row = record(1, validation=v, provider="https://x", model="m", seed=7, context={**record(1)["context"], "application_type": "Bearer x"})
    out = json.loads(export.sidecar(table(row)).first().json)
    assert out["provenance"] == {"model": "m", "seed": 7} and "application_type" not in out["context"] and out["context"]["sample_index"] == 1
    s = out["validation_summary"]
    assert s["reason_count"] == 2 and s["structural"] == {"passed": True, "vulnerable_markers": ["ok"], "fixed_markers": []} and s["window_balance"] == {"window_size": 200, "badpart_token_ratio": 0.007812}
    assert s["semgrep"]["after"] == {"status": "timeout", "finding_ids": ["q"]} and s["bandit"]["before"] == {"status": "success", "finding_ids": ["B608"]}
    assert "vulnerable_code" not in json.dumps(out) and out["review_summary"]["verdict"] == "pass"
    assert json.loads(export.sidecar(table({"ord": 1})).first().json)["mode"] == "unknown"


# --- validation --------------------------------------------------------------------------------------------


def verdict(table, strict=False, **more):
    r = validation.validate(table(record(1, **more)), strict).first().validation
    return r.passed, r.reasons, r.warnings


def test_a_sound_pair_is_valid(table):
    assert verdict(table) == (True, [], [])


def test_tools_that_are_away(table):
    v = {**record(1)["validation"], "bandit_before": {"available": False, "status": "missing", "findings": []}, "semgrep_after": {"available": False, "status": "error", "error": "trace\nlast"}}
    ok, reasons, warnings = verdict(table, validation=v)
    assert ok and warnings == ["bandit is not available", "semgrep failed to run: last"]
    ok, reasons, warnings = verdict(table, True, validation=v)
    assert not ok and reasons == ["bandit is not available", "semgrep failed to run: last"] and warnings == []
    ok, _, warnings = verdict(table, validation={**v, "bandit_after": {"available": False, "status": "timeout"}, "semgrep_before": None})
    assert warnings == ["bandit is not available", "semgrep is not available"]


def test_findings_against_expectations(table):
    v = record(1)["validation"]
    assert verdict(table, validation={**v, "bandit_before": OK})[2] == ["expected lint ids not reported before the fix: B608"]
    assert verdict(table, validation={**v, "bandit_after": TOOLS["bandit_before"]})[1] == ["expected lint ids still reported after the fix: B608"]
    assert verdict(table, validation={**v, "semgrep_before": OK})[1] == ["expected rules not reported before the fix: rules.cwe-89.sql-injection"]
    assert verdict(table, validation={**v, "semgrep_after": TOOLS["semgrep_before"]})[1] == ["expected rules still reported after the fix: rules.cwe-89.sql-injection"]
    assert verdict(table, validation={**v, "semgrep_after": {**OK, "findings": [{"check_id": "x.rules.cwe-79.xss"}]}})[1] == ["rules of other classes reported after the fix: rules.cwe-79.xss"]


def test_parts_and_balance(table):
    ok, reasons, _ = verdict(table, badparts=[], goodparts=None)
    assert reasons == ["no parts of the code before, badparts, to export", "no parts of the code after, goodparts, to export"]
    assert verdict(table, generation_profile="window_balanced")[1] == ["too few tokens", "no negative window"]
    clean = "".join(f"value_{i} = value_{i - 1} - {i} * 2\n" for i in range(1, 44))
    long = {"vulnerable_code": clean + BEFORE + clean.replace("value", "other"), "fixed_code": clean + AFTER + clean.replace("value", "other")}
    row = validation.validate(table(record(1, generation_profile="window_balanced", badparts=["cursor.execute(f\"SELECT * FROM users WHERE n = '{name}'\")"], **long))).first().validation
    b = row.window_balance
    assert row.passed and 420 <= b.vulnerable_token_count <= 900 and b.positive_window_count > 0 and b.negative_window_count > 0
    assert b.badpart_token_ratio == round(b.badpart_token_count / b.vulnerable_token_count, 6) < 0.15 and b.fixed_token_retention == round(b.fixed_token_count / b.vulnerable_token_count, 6)


def test_nulls_and_empty_tables_validate(table):
    row = validation.validate(table({"ord": 1})).first().validation
    assert not row.passed and row.reasons[0].startswith("no parts")
    assert validation.validate(table()).collect() == []


def test_findings_of_one_file(spark):
    df = spark.createDataFrame([([("a", "/t/v.py", None), ("b", None, "w/f.py"), ("c", "", ""), ("d", "v.py", None)],)], "f array<struct<id:string,filename:string,path:string>>")
    r = df.select(validation.split_findings(F.col("f"), F.lit("/t/v.py")).alias("v"), validation.split_findings(F.col("f"), F.lit("/t/f.py")).alias("f")).first()
    assert [x.id for x in r.v] == ["a", "d"] and [x.id for x in r.f] == ["b"]


@pytest.mark.parametrize(("code", "body", "state", "want"), [(0, '{"results": []}', "completed", "success"), (1, '{"results": [{}]}', "completed", "success"), (2, '{"results": []}', "completed", "error"), (0, "", "completed", "error"), (0, '{"results": 3}', "completed", "error"), (0, "x", "timeout", "timeout")])
def test_tool_states(spark, code, body, state, want):
    assert spark.range(1).select(policy.tool_status(F.lit(code), F.lit(body), "results", F.lit(state)).alias("v")).first().v == want


FULL = {"verdict": "pass", **dict.fromkeys(VERDICT_FLAGS, True), "reason_category": "none"}


@pytest.mark.parametrize(
    ("change", "good"),
    [
        ({}, True), ({"verdict": "fail", "reason_category": "other", "fix_correct": False}, True), ({"verdict": "unsure", "reason_category": "runtime_issue"}, True), ({"verdict": "fail"}, False), ({"verdict": "unsure"}, False), ({"fix_correct": False}, False),
        ({"reason_category": "other"}, False), ({"verdict": "maybe", "reason_category": "other"}, False), ({"verdict": "fail", "reason_category": "weak"}, False), ({"extra": 1}, False), ({"fix_correct": "true"}, False), ({"fix_correct": 1}, False), ({"verdict": None}, False),
    ],
)
def test_reviews_are_parsed_strictly(spark, change, good):
    df = spark.createDataFrame([(json.dumps({**FULL, **change}),)], "j string")
    assert (df.select(policy.parse_review(F.col("j")).alias("r")).first().r is not None) is good


def test_reviews_without_a_field_or_json(spark):
    rows = [(json.dumps({k: v for k, v in FULL.items() if k != "fix_correct"}),), ("[]",), ("no",), (None,)]
    assert [r.r for r in spark.createDataFrame(rows, "j string").select(policy.parse_review(F.col("j")).alias("r")).collect()] == [None] * 4


# --- revalidation, candidates -----------------------------------------------------------------------------------


def test_revalidation_keeps_and_sets_aside(table):
    bad = record(2, fixed_code=BEFORE)
    rows = [record(1), bad, record(3), record(4, review=None), record(5, context=None), record(6, mode="odd", context={**record(6)["context"], "cwe_key": None})]
    out = {r.ord: r for r in revalidation.revalidate(table(*rows)).collect()}
    assert [n for n, r in out.items() if r.revalidation is None] == [1, 3]
    assert out[2].revalidation.reason_categories == ["validation"] and out[4].revalidation.reason_categories == ["review"] and out[5].revalidation.reason_categories == ["record_schema"] == out[6].revalidation.reason_categories
    assert out[2].reject_reason == out[2].validation.reasons and not out[2].validation.passed and out[2].revalidation.source_id == "CWE-89_sql_000002"
    s = {(r.section, r.key): r.value for r in revalidation.summary(revalidation.revalidate(table(*rows[:3]))).collect()}
    assert s[("total", "retained")] == 2 and s[("total", "quarantined")] == 1 and s[("quarantined_by_mode", "sql")] == 1 and s[("reason_categories", "validation")] == 1


def test_the_profile_is_kept_when_revalidated(table):
    out = revalidation.revalidate(table(record(1, generation_profile="window_balanced"))).first()
    assert out.validation.window_balance is not None and out.revalidation.reason_categories == ["validation"]


def test_candidates(spark):
    ok = {"commit_message": " m ", "vulnerable_code": "a = 1\r\nb = 2", "fixed_code": "a = 1\nb = 3\n", "filename": "x", "vulnerable_lines": ["a = 1"], "fixed_lines": ["absent"]}
    rows = [json.dumps(ok), json.dumps({**ok, "vulnerable_lines": "b = 2", "filename": ""}), json.dumps({**ok, "fixed_code": " ", "commit_message": None}), "no", "[1]", json.dumps({**ok, "vulnerable_lines": [], "fixed_code": ok["vulnerable_code"]}), None]
    df = spark.createDataFrame([(i, r, "sql") for i, r in enumerate(rows)], "i int, r string, mode string")
    out = [x.candidate for x in candidates.normalise(df, "r", "mode").orderBy("i").collect()]
    assert (out[0].commit_message, out[0].filename, out[0].vulnerable_code, out[0].badparts, out[0].goodparts) == ("m", "x.py", "a = 1\nb = 2\n", ["a = 1"], ["b = 3"])
    assert out[1].badparts == ["b = 2"] and out[1].filename == "app.py" and out[2].error == "missing fields: commit_message, fixed_code"
    assert [x.error for x in out[3:]] == ["no JSON object", "no JSON object", None, "no JSON object"] and out[3].badparts is None
    assert out[5].diff == "\n" and out[5].badparts == []


def test_constant_replies_are_candidates_with_parts(spark):
    out = candidates.normalise(candidates.constant_replies(spark), "reply", "mode").collect()
    assert len(out) == 7 and all(r.candidate.error is None and r.candidate.badparts and r.candidate.goodparts for r in out)
    assert json.loads(candidates.PASSING_REVIEW) == FULL


@pytest.mark.parametrize(("body", "want"), [({"choices": [{"message": {"content": "a"}}]}, "a"), ({"choices": [{"message": {}}]}, ""), ({"choices": [{"text": "b"}]}, "b"), ({"response": "c", "text": "d"}, "c"), ({"output": [{"content": [{"text": "e"}, {"x": 1}]}, {"content": [{"text": "f"}]}, {}]}, "e\nf"), ({"x": 1}, None)])
def test_response_texts(spark, body, want):
    assert spark.createDataFrame([(json.dumps(body),)], "j string").select(candidates.response_text(F.col("j")).alias("v")).first().v == want


# --- logs, sinks ---------------------------------------------------------------------------------------------------------


def test_logs(spark, tmp_path):
    path = f"file://{tmp_path}/a.jsonl"
    assert files.read_log(spark, path, "id string").collect() == []
    with pytest.raises(Exception, match="(?i)path"):
        files.read_log(spark, path, "id string", strict=False).collect()
    (tmp_path / "a.jsonl").write_text('{"id": "x"}\n\n{"id": "y"}\n')
    assert sorted(r.id for r in files.read_log(spark, path, "id string").collect()) == ["x", "y"]
    (tmp_path / "a.jsonl").write_text('{"id": "x"}\n\n{"id": \nrest\n')
    with pytest.raises(ValueError, match=r"a\.jsonl:3$"):
        files.read_log(spark, path, "id string")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_log(spark, path, "id string", strict=False).collect()
    assert [(r.line_number, r.line) for r in files.bad_lines(spark, path).orderBy("line_number").collect()] == [(3, '{"id": '), (4, "rest")]


def test_appending_and_empty_logs(spark, tmp_path):
    a, b = files.ensure_logs(spark, f"file://{tmp_path}/d")
    assert files.read_log(spark, a).count() == files.read_log(spark, b).count() == 0
    df = spark.createDataFrame([("x", 1)], "b string, a int")
    path = f"file://{tmp_path}/log"
    files.write_log(df, path)
    files.write_log(df, path, append=True)
    assert [r.value for r in spark.read.text(path).collect()] == ['{"a":1,"b":"x"}'] * 2
    files.write_log(df, path)
    assert spark.read.text(path).count() == 1
    assert files.ensure_logs(spark, f"file://{tmp_path}/d") == (a, b)


def test_records_as_commits(table):
    rows = table(record(1, mode=" Path_Disclosure ", badparts=["a", " "], context=None), record(2, mode="odd"), record(3))
    got = {r.ord: r for r in files.load_records(rows).collect()}
    assert set(got) == {1, 3} and got[1].mode == "directory_traversal" and got[1].badparts == ["a"] and got[1].context.structure == "unknown"
    assert got[3].group_id == "synthetic:sql:curated:CWE-89_sql_000003"
    with pytest.raises(Exception, match="no id"):
        files.load_records(table(record(1, id=None))).collect()


def test_schemas_agree(spark):
    assert isinstance(spark.createDataFrame([], files.RECORD).schema, StructType)
