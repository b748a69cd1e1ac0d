"""The nested layout repository → commit → files → changes, its sidecar, and checks on both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.pycode import unified_diff
from sluicebox.functions.registry import MODES
from sluicebox.functions.safe import UNSAFE, finding_ids, relative_filename, safe_float, safe_integer, safe_text
from sluicebox.functions.text import changed_parts, strip
from sluicebox.operators import reports
from sluicebox.operators.tools import run_status, tool_run
from sluicebox.sources.small import write_text

CHANGE = "STRUCT<diff: STRING, add: INT, remove: INT, filename: STRING, badparts: ARRAY<STRING>, goodparts: ARRAY<STRING>>"
COMMIT = f"STRUCT<msg: STRING, files: MAP<STRING, STRUCT<source: STRING, sourceWithComments: STRING, sourcecodeafter: STRING, changes: ARRAY<{CHANGE}>>>>"
LAYOUT = f"MAP<STRING, MAP<STRING, {COMMIT}>>"


#: Overwritten records up to which their keys are broadcast.
OVERWRITTEN = 100_000


def flat_commits(records: DataFrame) -> DataFrame:
    """``mode, repo, commit_id, filename`` and the exported fields of each record, the last record of a commit id winning.

    A record without a safe id is named after its row index within the mode.
    """
    name = F.coalesce(safe_text(F.col("id").cast("string")), F.format_string("sample_%06d", F.col("row_index")))
    repo = F.concat(F.lit("curated/"), F.coalesce(safe_text(F.col("mode")), F.lit("unknown")))
    body = F.struct(
        F.coalesce(safe_text(F.col("commit_message")), F.lit("Synthetic security fix")).alias("msg"),
        relative_filename(F.col("filename")).alias("filename"),
        F.concat(strip(F.col("vulnerable_code")), F.lit("\n")).alias("before"),
        F.concat(strip(F.col("fixed_code")), F.lit("\n")).alias("after"),
        F.col("diff"), F.col("badparts"), F.col("goodparts"),
    )
    keys = ["mode", "repo", "commit_id"]
    flat = records.select("mode", repo.alias("repo"), name.alias("commit_id"), "ord", body.alias("b"))
    # Which records are overwritten is known from their keys; the texts don't meet by commit.
    several = flat.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("ord").alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    met = flat.select(*keys, "ord").join(several, same)
    if met.where("ord is null or ord = _last").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return flat.groupBy(*keys).agg(F.max_by("b", "ord").alias("b")).select(*keys, "b.*")
    lost = met.where("ord < _last").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("ord").alias("_ord"))
    lost = F.broadcast(lost) if lost.limit(OVERWRITTEN + 1).count() <= OVERWRITTEN else lost
    return flat.join(lost, [*same, F.col("ord") == F.col("_ord")], "left_anti").select(*keys, "b.*")


def prepared(records: DataFrame) -> DataFrame:
    """The records with ``mode`` (their own, else the context's, else unknown) and ``row_index`` within it, a diff without anything
    unsafe (else made anew), and parts (where one side has none, both come from the diff)."""
    mode = F.coalesce(F.nullif(F.col("mode"), F.lit("")), F.nullif(F.col("context")["mode"], F.lit("")), F.lit("unknown"))
    rows = records.withColumn("mode", mode)
    rows = reports.row_index(rows, "mode", "ord")
    text = lambda c: F.coalesce(c, F.lit(""))
    fresh = unified_diff(F.when(_unsafe("diff"), text("vulnerable_code")), F.when(_unsafe("diff"), text("fixed_code")), relative_filename(F.col("filename")))
    rows = rows.withColumn("_fresh", fresh).withColumn("diff", F.when(_unsafe("diff"), F.col("_fresh")).otherwise(text("diff"))).drop("_fresh")
    none = F.array().cast("array<string>")
    empty = (F.size(F.coalesce("badparts", none)) == 0) | (F.size(F.coalesce("goodparts", none)) == 0)
    rows = rows.withColumns({"_bad": F.when(empty, changed_parts(F.col("diff"), "-")).otherwise(F.col("badparts")), "_good": F.when(empty, changed_parts(F.col("diff"), "+")).otherwise(F.col("goodparts"))})
    return rows.withColumns({"badparts": F.col("_bad"), "goodparts": F.col("_good")}).drop("_bad", "_good")


def _unsafe(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(UNSAFE), F.lit(False))


def exported(records: DataFrame) -> DataFrame:
    """:func:`flat_commits` of records as they come from a log."""
    return flat_commits(prepared(records))


def _safe_fields(value: Column, fields: list[str], kind: Callable[[Column], Column]) -> list[Column]:
    return [kind(value[f]).alias(f) for f in fields]


def sidecar(records: DataFrame) -> DataFrame:
    """``mode, row_index, repo, commit_id, filename, json``: the metadata row of every record, only allowed fields with safe values.

    Absent values are left out of the JSON. A record whose commit id another one overwrites keeps its row.
    """
    rows = prepared(records)
    commit = F.coalesce(safe_text(F.col("id")), F.format_string("sample_%06d", F.col("row_index")))
    mode = F.coalesce(safe_text(F.col("mode")), F.lit("unknown"))
    repo = F.concat(F.lit("curated/"), mode)
    name = relative_filename(F.col("filename"))
    c, v, r = F.col("context"), F.col("validation"), F.col("review")
    own = lambda x: safe_text(x.cast("string"))
    context = F.struct(*_safe_fields(c, ["cwe_key", "cwe", "cwe_name", "mode", "application_type", "flow_pattern", "difficulty", "structure"], own), c["sample_index"].alias("sample_index"), own(c["generation_profile"]).alias("generation_profile"))
    source = F.struct(*[own(F.col(f)).alias(f) for f in ("provider", "model", "prompt_sha256", "generated_at")], F.col("seed"), F.col("attempt"))
    yes = lambda x: F.coalesce(x, F.lit(False))
    n = lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))
    none = F.array().cast("array<string>")
    safe_list = lambda x: F.coalesce(F.filter(F.transform(x, lambda y: safe_text(y)), lambda y: y.isNotNull()), none)

    def tool(t: str) -> Column:
        def phase(p: str) -> Column:
            run = tool_run(v, t, p, unphased=True)
            ids = F.transform(run["findings"], lambda x: x["test_id" if t == "bandit" else "check_id"])
            return F.struct(run_status(run).alias("status"), F.coalesce(finding_ids(ids), none).alias("finding_ids"))

        return F.struct(phase("before").alias("before"), phase("after").alias("after"))

    b = v["window_balance"]
    whole = ["window_size", "stride", "vulnerable_token_count", "fixed_token_count", "positive_window_count", "negative_window_count", "badpart_token_count"]
    balance = F.when(b.isNotNull(), F.struct(*_safe_fields(b, whole, safe_integer), *_safe_fields(b, ["badpart_token_ratio", "fixed_token_retention"], safe_float)))
    checks = F.struct(
        yes(v["passed"]).alias("passed"), n(v["reasons"]).alias("reason_count"), n(v["warnings"]).alias("warning_count"),
        F.struct(yes(v["structural"]["passed"]).alias("passed"), safe_list(v["structural"]["vulnerable_markers"]).alias("vulnerable_markers"), safe_list(v["structural"]["fixed_markers"]).alias("fixed_markers")).alias("structural"),
        tool("bandit").alias("bandit"), tool("semgrep").alias("semgrep"), balance.alias("window_balance"),
    )
    review = F.when(r.isNotNull(), F.struct(r["required"].alias("required"), *_safe_fields(r, ["status", "verdict", "reason_category", "provider", "model"], own), *[r[f].alias(f) for f in ("cwe_correct", "fix_correct", "context_correct", "runtime_plausible")]))
    profile = F.coalesce(own(F.coalesce(F.nullif(F.col("generation_profile"), F.lit("")), c["generation_profile"])), F.lit("compact"))
    out = rows.select("mode", "row_index", repo.alias("repo"), commit.alias("commit_id"), name.alias("filename"), F.struct(
        F.coalesce(own(F.col("id")), commit).alias("id"), F.coalesce(own(F.col("cwe")), F.lit("unknown")).alias("cwe"), F.coalesce(own(F.col("cwe_name")), F.lit("unknown")).alias("cwe_name"), mode.alias("mode"), F.concat(F.lit("plain_"), mode).alias("plain_file"),
        F.col("row_index"), repo.alias("repo"), commit.alias("commit_id"), name.alias("filename"), profile.alias("generation_profile"), context.alias("context"), source.alias("provenance"), checks.alias("validation_summary"), review.alias("review_summary"),
    ).alias("j"))
    return out.withColumn("json", F.to_json("j")).drop("j")


#: Characters of JSON up to which a mode's layout is one document in one file.
ONE_FILE = 256 << 20


def write_export(records: DataFrame, folder: str, one_file: int = ONE_FILE) -> dict[str, int]:
    """Writes ``plain_<mode>`` for each known mode, {} where it has no commits, and the sidecar ``metadata.jsonl``; returns commits by mode.

    A mode of more than ``one_file`` characters, which no machine should hold as one document, is a
    folder of that name with a commit a line instead; the sidecar is always a folder of lines.
    """
    spark = records.sparkSession
    flat = exported(records)
    lines = commit_lines(flat)
    sizes = {r["mode"]: (r["n"], r["chars"]) for r in lines.where(F.col("mode").isin(MODES)).groupBy("mode").agg(F.count("*").alias("n"), F.sum(F.length("json")).alias("chars")).collect()}
    small = [m for m in MODES if sizes.get(m, (0, 0))[1] <= one_file]
    modes = spark.createDataFrame([(m,) for m in small], "mode string")
    for r in layout(flat.where(F.col("mode").isin(small)), modes).toLocalIterator():  # a mode at a time, each of a checked size
        write_text(spark, f"{folder}/plain_{r['mode']}", r["json"])
    for m in (m for m in MODES if m not in small):
        lines.where(F.col("mode") == m).drop("mode").write.mode("overwrite").json(f"{folder}/plain_{m}")
    sidecar(records).select("json").write.mode("overwrite").text(f"{folder}/metadata.jsonl")
    return {m: sizes.get(m, (0, 0))[0] for m in MODES}


def commit_struct() -> Column:
    change = F.struct(F.col("diff"), F.size("goodparts").alias("add"), F.size("badparts").alias("remove"), F.col("filename"), F.col("badparts"), F.col("goodparts"))
    file = F.struct(F.concat(F.lit("\n"), F.col("before")).alias("source"), F.col("before").alias("sourceWithComments"), F.col("after").alias("sourcecodeafter"), F.array(change).alias("changes"))
    return F.struct(F.col("msg"), F.map_from_arrays(F.array("filename"), F.array(file)).alias("files"))


def commit_lines(flat: DataFrame) -> DataFrame:
    """``mode, repo, commit_id, filename, json``: the layout a commit a line; at scale a file of all commits would be one task's memory."""
    return flat.select("mode", "repo", "commit_id", "filename", F.to_json(commit_struct()).alias("json"))


def layout(flat: DataFrame, modes: DataFrame) -> DataFrame:
    """``mode, json``: the whole document of each mode, {} for one without commits. For small exports: a mode is one value."""
    # JSON of JSON strings would be quoted twice, so the document is put together from its parts.
    text = flat.groupBy("mode", "repo").agg(F.array_sort(F.collect_list(F.concat(F.to_json(F.array("commit_id")), F.lit("\x00"), F.to_json(commit_struct())))).alias("c"))
    inner = F.concat(F.lit("{"), F.array_join(F.transform("c", lambda x: F.concat(_name(x), F.lit(": "), F.element_at(F.split(x, "\x00", 2), 2))), ", "), F.lit("}"))
    docs = text.groupBy("mode").agg(F.array_sort(F.collect_list(F.concat(_name(F.to_json(F.array("repo"))), F.lit(": "), inner))).alias("d"))
    return modes.select("mode").join(docs, "mode", "left").select("mode", F.coalesce(F.concat(F.lit("{"), F.array_join("d", ", "), F.lit("}")), F.lit("{}")).alias("json"))


def _name(x: Column) -> Column:
    """The quoted string within a one-item JSON array."""
    return F.regexp_extract(F.element_at(F.split(x, "\x00", 2), 1), r"(?s)^\[(.*)\]$", 1)


def layout_commits(spark: SparkSession, paths: list[tuple[str, str]]) -> DataFrame:
    """``mode, repo, commit_id, filename, json`` of files or folders (mode, path) that :func:`write_export` wrote, to compare with :func:`commit_lines`.

    A file is one document; a folder has a commit a line.
    """
    out = spark.createDataFrame([], "mode string, repo string, commit_id string, filename string, json string")
    for mode, path in paths:  # a path per class
        text = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
        rows = text.select(F.explode(F.from_json("text", LAYOUT)).alias("repo", "commits")).select("repo", F.explode("commits").alias("commit_id", "c"))
        lines = spark.read.schema("repo string, commit_id string, filename string, json string").json(path).where("json is not null").select(F.lit(mode).alias("mode"), "repo", "commit_id", "filename", "json")
        one = rows.select(F.lit(mode).alias("mode"), "repo", "commit_id", F.element_at(F.map_keys("c.files"), 1).alias("filename"), F.to_json("c").alias("json"))
        out = out.unionByName(one).unionByName(lines)
    return out


def flatten(documents: DataFrame) -> DataFrame:
    """``mode, repo, commit_id, filename, msg, source, fixed_source, badparts, goodparts`` of documents ``mode, json``; malformed levels are passed over."""
    repos = documents.select("mode", F.explode(F.from_json("json", LAYOUT)).alias("repo", "commits"))
    commits = repos.select("mode", "repo", F.explode("commits").alias("commit_id", "c"))
    files = commits.select("mode", "repo", "commit_id", F.col("c.msg").alias("msg"), F.explode("c.files").alias("filename", "f"))
    parts = lambda k: F.flatten(F.transform("f.changes", lambda x: F.coalesce(x[k], F.array().cast("array<string>"))))
    source = F.coalesce(F.nullif(F.col("f.sourceWithComments"), F.lit("")), F.col("f.source"))
    return files.select("mode", "repo", "commit_id", "filename", "msg", source.alias("source"), F.col("f.sourcecodeafter").alias("fixed_source"), parts("badparts").alias("badparts"), parts("goodparts").alias("goodparts"))


def broken_links(sidecar: DataFrame, flat: DataFrame) -> DataFrame:
    """Sidecar rows whose repository, commit and file don't exist in the layout."""
    return sidecar.join(flat.select("repo", "commit_id", "filename").distinct(), ["repo", "commit_id", "filename"], "left_anti")
