"""Commands over logs in a folder: ``python -m sluicebox.cli export|verify|revalidate|prepare|plan|evaluate``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.registry import MODES
from sluicebox.operators import coverage, export, metrics, models, planner, release, revalidation, verify
from sluicebox.sources import files, small


def with_ord(log: DataFrame) -> DataFrame:
    """The log with ``ord``: its own, else the place of the line among the files, which is fixed once the log is written."""
    line = F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    from sluicebox.operators.order import running_before

    if "ord" in log.columns and log.where("ord is null").limit(1).count() == 0:
        return log
    return running_before(log.withColumn("_line", line), [F.col("_line")], F.lit(1), "_at").withColumn("ord", F.col("_at")).drop("_line", "_at")


def read(spark: SparkSession, path: str) -> DataFrame:
    log = files.read_log(spark, path)
    return with_ord(log) if small.exists(spark, path) else log


def run_export(spark: SparkSession, a: argparse.Namespace) -> int:
    for mode, n in export.write_export(read(spark, a.input), a.out).items():
        print(f"{n} commits in plain_{mode}")
    return 0


def _layout_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """What stands in an export: commits, sidecar rows, names of files."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    plain = [n for n in names if n.startswith("plain_")]
    none = spark.createDataFrame([], "mode string, repo string, commit_id string, filename string, json string")
    commits = export.layout_commits(spark, [(n.removeprefix("plain_"), f"{folder}/{n}") for n in plain]) if plain else none
    side = spark.read.text(f"{folder}/metadata.jsonl").select(F.col("value").alias("json")) if "metadata.jsonl" in names else spark.createDataFrame([], "json string")
    get = lambda f: F.get_json_object("json", f"$.{f}").alias(f)
    return commits, side.select(get("mode"), get("row_index").cast("int").alias("row_index"), get("repo"), get("commit_id"), get("filename"), "json"), names


def run_verify(spark: SparkSession, a: argparse.Namespace) -> int:
    errors, logs = [], []
    for code, path in (("accepted_input", a.input), ("rejected_input", a.rejected)):
        try:
            logs.append(read(spark, path))
        except ValueError:
            errors.append((code,))
            logs.append(spark.createDataFrame([], files.RECORD))
    plain, side, names = _layout_of(spark, a.layout)
    summary, issues = verify.verify(*logs, plain, side, names)
    broken = verify.issue(spark.createDataFrame(errors, "code string"), "input", F.col("code"))
    out = verify.report(summary, broken.unionByName(issues))
    small.write_report(spark, out, a.out)
    print(f"{out['status']}: {out['error_count']} errors, report in {a.out}")
    return 0 if out["status"] == "pass" else 1


def run_revalidate(spark: SparkSession, a: argparse.Namespace) -> int:
    source, target = f"{a.input}/samples.jsonl", a.output
    if a.input == a.output or not small.exists(spark, source) or small.exists(spark, target):
        raise SystemExit("the source must hold samples.jsonl, and the target must be another, new folder")
    results = files.stored(revalidation.revalidate(read(spark, source), a.strict))
    files.write_log(results.where("revalidation is null"), f"{target}/samples.jsonl")
    files.write_log(results.where("revalidation is not null"), f"{target}/rejected.jsonl")
    kept = results.where("revalidation is null")
    export.write_export(kept, f"{target}/export")
    plain, side, names = _layout_of(spark, f"{target}/export")
    out = verify.report(*verify.verify(kept, results.where("revalidation is not null"), plain, side, names))
    small.write_report(spark, out, f"{target}/dataset_verification.json")
    counts = {}
    for r in revalidation.summary(results).collect():  # by class and category
        counts.setdefault(r["section"], {})[r["key"]] = r["value"]
    small.write_report(spark, counts | {"verification_status": out["status"], "verification_error_count": out["error_count"]}, f"{target}/revalidation_summary.json")
    print(f"{counts.get('total', {})}, verification: {out['status']}")
    return 0 if out["status"] == "pass" else 1


def run_prepare(spark: SparkSession, a: argparse.Namespace) -> int:
    out = release.prepare(files.load_records(read(spark, a.synthetic)), files.load_layout(spark, a.layout), a.per_mode, a.seed, a.positive, a.negative)
    for name, rows in (("synthetic_selected", out.synthetic), ("real_selected", out.real), ("commit_splits", out.splits), ("windows", out.windows)):
        files.write_log(rows, f"{a.out}/manifests/{name}.jsonl")
    files.write_log(out.audit, f"{a.out}/audit/pairs.jsonl")
    if a.report:
        small.copy_report(spark, a.report, f"{a.out}/audit/source_dataset_verification.json")
    columns = ["dataset", "mode", "group_id"]
    counts: dict = {}
    for r in release.release_summary(out.synthetic.select(columns).unionByName(out.real.select(columns)), spark.read.json(f"{a.out}/manifests/windows.jsonl")).collect():  # by class and split
        counts.setdefault(r["section"], {})[r["key"]] = r["value"]
    small.write_report(spark, counts | {"seed": a.seed, "per_mode": a.per_mode, "unbounded_window_count": out.window_count.first()["n"]}, f"{a.out}/dataset_summary.json")
    return 0


def run_plan(spark: SparkSession, a: argparse.Namespace) -> int:
    modes = planner.wanted_modes(a.cwe)
    if not modes:
        print("no class of these names")
        return 2
    have = planner.records_of(read(spark, a.input), a.profile)
    planned = planner.plan(have, a.per_mode, modes, a.profile, a.seed)
    files.write_log(planned, a.out)
    coverage.plan_summary(have, planned, planned.where("false"), a.profile).where(F.col("mode").isin(modes)).show(truncate=False)
    return 0


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = spark.read.json(f"{a.release}/manifests/windows.jsonl").withColumn("row", F.monotonically_increasing_id())
    rows = files.stored(rows)
    modes = [m for m in MODES if m in (a.mode or MODES)]
    release.assert_slices(rows, modes)
    vectors = files.stored(models.word_vectors(rows.where("split = 'train'"), width=a.width, least=a.least, seed=a.seed))
    feats = files.stored(models.pooled_features(rows.withColumn("label", F.col("label").cast("double")), vectors, "row", a.width))
    used = metrics.conditions(feats.where(F.col("mode").isin(modes)))
    found = None
    for mode in modes:  # a model for each class and condition
        for condition in "ABC":
            part = used.where((F.col("mode") == mode) & (F.col("condition") == condition))
            train, test = part.where("role = 'train'"), part.where("role = 'test'")
            guesses = {"forest": models.forest(train, test, a.trees, a.seed), "mlp": models.perceptron(train, test, a.width, rounds=a.rounds, seed=a.seed)}
            for name, guessed in guesses.items():
                cells = metrics.confusion(guessed.select(F.col("label").cast("int").alias("truth"), "guess", F.lit(mode).alias("mode"), F.lit(condition).alias("condition"), F.lit(name).alias("model")), ["mode", "condition", "model"])
                one = metrics.metrics(cells, ["mode", "condition", "model"]).join(cells.select("mode", "condition", "model", (F.col("tp") + F.col("fn")).alias("positive_support")), ["mode", "condition", "model"])
                found = one if found is None else found.unionByName(one)
    files.write_metrics(files.stored(found), a.out)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sluicebox")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *options):  # noqa: ANN001, ANN002, ANN202
        c = sub.add_parser(name)
        for flag, kw in options:
            c.add_argument(flag, **kw)
        c.set_defaults(run=run)

    need = lambda f: (f, {"required": True})
    number = lambda f, d: (f, {"type": int, "default": d})
    command("export", run_export, need("--input"), need("--out"))
    command("verify", run_verify, need("--input"), need("--rejected"), need("--layout"), need("--out"))
    command("revalidate", run_revalidate, need("--input"), need("--output"), ("--strict", {"action": "store_true"}))
    command("prepare", run_prepare, need("--synthetic"), need("--layout"), need("--out"), number("--per-mode", 91), number("--seed", 20260624), number("--positive", 4), number("--negative", 4), ("--report", {}))
    command("plan", run_plan, need("--input"), need("--out"), number("--per-mode", 149), number("--seed", 1337), ("--cwe", {"action": "append"}), ("--profile", {"default": "compact", "choices": ["compact", "window_balanced"]}))
    command("evaluate", run_evaluate, need("--release"), need("--out"), number("--width", models.WIDTH), number("--least", models.LEAST), number("--trees", 300), number("--rounds", 500), number("--seed", 20260624), ("--mode", {"action": "append"}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(spark or SparkSession.builder.appName("sluicebox").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
