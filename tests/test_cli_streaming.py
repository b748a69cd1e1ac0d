from __future__ import annotations

import json

import pytest
from test_policy_verify import AFTER, BEFORE, record

from sluicebox import cli
from sluicebox.functions.registry import MODES
from sluicebox.operators.export import LAYOUT
from sluicebox.sources.small import read_text
from sluicebox.streaming.intake import intake, read_stream


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_export_and_verify(spark, tmp_path):
    rows = [{k: v for k, v in record(n).items() if k != "ord"} for n in (1, 30, 60)]
    write(tmp_path / "in.jsonl", rows)
    at = f"file://{tmp_path}"
    assert cli.main(["export", "--input", f"{at}/in.jsonl", "--out", f"{at}/out"], spark) == 0
    run = ["verify", "--input", f"{at}/in.jsonl", "--rejected", f"{at}/none.jsonl", "--layout", f"{at}/out", "--out", f"{at}/report.json"]
    assert cli.main(run, spark) == 0
    assert json.loads(read_text(spark, f"{at}/report.json"))["status"] == "pass"
    write(tmp_path / "in.jsonl", rows[:2])
    assert cli.main(run, spark) == 1
    codes = {e["code"] for e in json.loads(read_text(spark, f"{at}/report.json"))["errors"]}
    assert codes == {"plain_payload_mismatch", "metadata_payload_mismatch"}
    (tmp_path / "in.jsonl").write_text("{broken\n")
    assert cli.main(run, spark) == 1
    assert "accepted_input" in {e["code"] for e in json.loads(read_text(spark, f"{at}/report.json"))["errors"]}


def test_revalidate(spark, tmp_path):
    write(tmp_path / "src" / "samples.jsonl", [record(1), record(2, fixed_code=BEFORE), record(3)])
    at = f"file://{tmp_path}"
    assert cli.main(["revalidate", "--input", f"{at}/src", "--output", f"{at}/new"], spark) == 0
    assert spark.read.text(f"{at}/new/samples.jsonl").count() == 2 and spark.read.text(f"{at}/new/rejected.jsonl").count() == 1
    assert json.loads(read_text(spark, f"{at}/new/revalidation_summary.json"))["reason_categories"] == {"validation": 1}
    with pytest.raises(SystemExit):
        cli.main(["revalidate", "--input", f"{at}/src", "--output", f"{at}/new"], spark)


def test_plan(spark, tmp_path):
    write(tmp_path / "s.jsonl", [record(1), record(2)])
    at = f"file://{tmp_path}"
    assert cli.main(["plan", "--input", f"{at}/s.jsonl", "--out", f"{at}/plan", "--per-mode", "5", "--cwe", "CWE-89"], spark) == 0
    assert sorted(r.sample_index for r in spark.read.json(f"{at}/plan").collect()) == [3, 4, 5]
    assert cli.main(["plan", "--input", f"{at}/s.jsonl", "--out", f"{at}/plan2", "--cwe", "zzz"], spark) == 2


def test_prepare_and_evaluate(spark, tmp_path):
    made, plain = [], {}
    for m in MODES[:]:
        for i in range(12):
            code = ("def f(x):\n    bad_call(x)\n" if i % 2 else "def g(y):\n    fine(y)\n") + "z = 1\n" * 5
            ctx = {**record(1)["context"], "mode": m, "application_type": ["Flask", "API"][i % 2]}
            made.append(record(i, id=f"{m}_{i}", mode=m, vulnerable_code=code + f"n_{i} = {i}\n", fixed_code=AFTER, badparts=["bad_call(x)"], context=ctx))
            change = {"diff": "", "add": 1, "remove": 1, "filename": "a.py", "badparts": ["bad_call(x)"], "goodparts": ["q"]}
            plain.setdefault(m, {}).setdefault("r", {})[f"c{i}"] = {"msg": "m", "files": {"a.py": {"source": code, "sourceWithComments": code + f"k = {i}\n", "sourcecodeafter": "", "changes": [change]}}}
    write(tmp_path / "made.jsonl", [{**r, "ord": k} for k, r in enumerate(made)])
    for m, doc in plain.items():
        (tmp_path / f"plain_{m}").write_text(json.dumps(doc))
    at = f"file://{tmp_path}"
    (tmp_path / "v.json").write_text("{}")
    assert cli.main(["prepare", "--synthetic", f"{at}/made.jsonl", "--layout", at, "--out", f"{at}/rel", "--per-mode", "10", "--report", f"{at}/v.json"], spark) == 0
    s = json.loads(read_text(spark, f"{at}/rel/dataset_summary.json"))
    assert s["synthetic_commits"] == dict.fromkeys(MODES, 10) == s["real_commits"] and s["unbounded_window_count"] == 140 and read_text(spark, f"{at}/rel/audit/source_dataset_verification.json") == "{}"
    run = ["evaluate", "--release", f"{at}/rel", "--out", f"{at}/eval", "--width", "4", "--least", "1", "--trees", "5", "--rounds", "5", "--mode", "xss"]
    assert cli.main(run, spark) == 0
    rows = json.loads(read_text(spark, f"{at}/eval/metrics.json"))
    assert sorted((r["condition"], r["model"]) for r in rows) == [(c, m) for c in "ABC" for m in ("forest", "mlp")] and all(r["support"] == 2 for r in rows)
    assert LAYOUT.startswith("MAP")


def test_a_stream_of_records_is_decided_once(spark, tmp_path):
    at = f"file://{tmp_path}"
    write(tmp_path / "in" / "1.json", [record(1), record(2, id="x", vulnerable_code=record(1)["vulnerable_code"], fixed_code=record(1)["fixed_code"])])
    stream = lambda: intake(read_stream(spark, f"{at}/in"), f"{at}/index", f"{at}/check").trigger(availableNow=True).start()
    stream().awaitTermination()
    got = lambda: {r.ord: r.accepted for r in spark.read.parquet(f"{at}/index").collect()}
    assert got() == {1: True, 2: False}
    write(tmp_path / "in" / "2.json", [record(3, vulnerable_code=record(1)["vulnerable_code"], fixed_code=record(1)["fixed_code"]), record(60)])
    stream().awaitTermination()
    assert got() == {1: True, 2: False, 3: False, 60: True}
    stream().awaitTermination()
    assert spark.read.parquet(f"{at}/index").count() == 4
