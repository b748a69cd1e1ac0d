"""JSON-lines logs, metric files, text corpora."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluicebox.functions.registry import MODES
from sluicebox.functions.safe import fold_mode
from sluicebox.functions.text import strip, tokens
from sluicebox.operators.export import flatten
from sluicebox.operators.order import running_before
from sluicebox.operators.schemas import VALIDATION
from sluicebox.operators.selection import group_id
from sluicebox.sources.shared import written
from sluicebox.sources.small import exists, write_text

REVIEW = "STRUCT<required: BOOLEAN, status: STRING, verdict: STRING, cwe_correct: BOOLEAN, fix_correct: BOOLEAN, context_correct: BOOLEAN, runtime_plausible: BOOLEAN, reason_category: STRING, provider: STRING, model: STRING>"
CONTEXT = "STRUCT<cwe_key: STRING, cwe: STRING, cwe_name: STRING, mode: STRING, application_type: STRING, flow_pattern: STRING, difficulty: STRING, structure: STRING, sample_index: INT, generation_profile: STRING>"
RECORD = f"""ord BIGINT, id STRING, cwe STRING, cwe_name STRING, mode STRING, context {CONTEXT},
generation_profile STRING, attempt INT, seed INT, generated_at STRING, prompt_sha256 STRING, commit_message STRING, filename STRING,
vulnerable_code STRING, fixed_code STRING, diff STRING, badparts ARRAY<STRING>, goodparts ARRAY<STRING>, provider STRING, model STRING,
validation {VALIDATION}, review {REVIEW}, reject_reason ARRAY<STRING>, diversity_rejection STRUCT<check: STRING, reason: STRING>,
revalidation STRUCT<source_id: STRING, status: STRING, reason_categories: ARRAY<STRING>>"""


def read_log(spark: SparkSession, path: str, schema: str | StructType = RECORD, strict: bool = True) -> DataFrame:
    """A JSON-lines log. Strict: a missing path is no rows, and a bad line is an error that names its file and line; else a
    missing path fails, too, and a bad line fails the read when it is met. Blank lines are passed over.

    Numbering reads only the lines that aren't records, with the sizes of what stands before them.
    """
    wanted = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    if not strict:
        return spark.read.schema(wanted).option("mode", "FAILFAST").json(path)
    if not exists(spark, path):
        return spark.createDataFrame([], wanted)
    bad = bad_lines(spark, path).orderBy("file", "line_number").limit(1).collect()
    if bad:
        raise ValueError(f"not a JSON record: {bad[0]['file']}:{bad[0]['line_number']}")
    return spark.read.schema(wanted).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that aren't JSON objects, for a report: ``file, line_number, line``; blank lines are none."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    broken = (F.trim("line") != "") & ~F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False))
    found = lines.where(broken)
    if found.limit(1).count() == 0:
        return found.select("file", F.lit(1).cast("bigint").alias("line_number"), "line")
    # Rows of a block are numbered in order, blocks by their start: only block sizes are summed.
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("file", "block", "first", before.alias("base"))
    return found.join(F.broadcast(base), ["file", "block"]).select("file", (F.col("base") + F.col("row") - F.col("first") + 1).alias("line_number"), "line")


def sorted_columns(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def write_log(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines with keys in alphabetic order."""
    sorted_columns(df).write.mode("append" if append else "overwrite").json(path)


def ensure_logs(spark: SparkSession, folder: str, schema: str = RECORD) -> tuple[str, str]:
    """Paths of the accepted and the rejected log, which are made, empty, where they aren't there."""
    paths = f"{folder}/samples.jsonl", f"{folder}/rejected.jsonl"
    for path in paths:
        if not exists(spark, path):
            spark.createDataFrame([], schema).write.json(path)
    return paths


METRICS = ["mode", "condition", "model", "accuracy", "precision", "recall", "f1", "macro_f1", "support", "positive_support"]


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """metrics.csv (no matrix), metrics.json, and comparison.md: the mean macro-F1 of each model and condition. A row per trained model."""
    rows = metrics.orderBy("mode", "condition", "model")
    write_text(metrics.sparkSession, f"{folder}/metrics.csv", "\n".join([",".join(METRICS), *(",".join(str(r[c]) for c in METRICS) for r in rows.select(*METRICS).toLocalIterator())]) + "\n")
    write_text(metrics.sparkSession, f"{folder}/metrics.json", json.dumps([r.asDict(recursive=True) for r in rows.toLocalIterator()], indent=2) + "\n")
    means = metrics.groupBy("model", "condition").agg(F.avg("macro_f1").alias("m")).orderBy("model", "condition").collect()
    lines = ["| model | condition | mean macro-F1 |", "|---|---:|---:|", *(f"| {r['model']} | {r['condition']} | {r['m']:.4f} |" for r in means)]
    write_text(metrics.sparkSession, f"{folder}/comparison.md", "\n".join(lines) + "\n")


def stored(df: DataFrame) -> DataFrame:
    """A table in the shared folder, for results that are read several times."""
    return written(df, "stored")


def write_features(features: DataFrame, path: str, keys: tuple[str, ...] = ("mode", "dataset", "split", "form")) -> DataFrame:
    """A feature table partitioned by its keys, so that a slice is read alone; the table as it is read back."""
    features.write.mode("overwrite").partitionBy(*keys).parquet(path)
    return features.sparkSession.read.parquet(path)


def load_records(log: DataFrame) -> DataFrame:
    """Accepted records as files of commits: ``dataset, mode, commit_id, repo, filename, source, fixed_source, badparts, goodparts, context, group_id, ord``.

    Rows of unknown modes are left out; a missing context value is ``unknown``; blank parts go.
    A record without an id is an error when it is read.
    """
    rows = log.withColumn("mode", fold_mode(F.col("mode"))).where(F.col("mode").isin(MODES))
    part = lambda c: F.coalesce(F.filter(c, lambda x: strip(x) != ""), F.array().cast("array<string>"))
    value = lambda f: F.coalesce(F.col("context")[f], F.lit("unknown")).alias(f)
    commit = F.when(F.col("id").isNotNull(), F.col("id")).otherwise(F.raise_error(F.lit("a record has no id")).cast("string"))
    out = rows.select(
        F.lit("synthetic").alias("dataset"), "mode", commit.alias("commit_id"), F.lit("curated").alias("repo"), F.coalesce("filename", F.lit("sample.py")).alias("filename"), F.coalesce("vulnerable_code", F.lit("")).alias("source"),
        F.coalesce("fixed_code", F.lit("")).alias("fixed_source"), part(F.col("badparts")).alias("badparts"), part(F.col("goodparts")).alias("goodparts"), F.struct(*[value(f) for f in CONTEXT_FIELDS]).alias("context"), "ord",
    )
    return out.withColumn("group_id", group_id(F.col("dataset"), F.col("mode"), F.col("repo"), F.col("commit_id")))


CONTEXT_FIELDS = ["application_type", "flow_pattern", "difficulty", "structure"]


def load_layout(spark: SparkSession, folder: str) -> DataFrame:
    """The files ``plain_<mode>`` of a folder, in the columns of :func:`load_records` but for ``ord``; unknown modes and malformed levels are passed over."""
    files = spark.read.text(f"{folder}/plain_*", wholetext=True).select(fold_mode(F.regexp_extract(F.col("_metadata.file_name"), r"\Aplain_(.*)\z", 1)).alias("mode"), F.col("value").alias("json"))
    part = lambda c: F.filter(F.col(c), lambda x: strip(x) != "").alias(c)
    context = F.struct(*[F.lit("legacy_unknown").alias(f) for f in CONTEXT_FIELDS]).alias("context")
    out = flatten(files.where(F.col("mode").isin(MODES))).select(F.lit("real").alias("dataset"), "mode", "commit_id", "repo", "filename", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("fixed_source", F.lit("")).alias("fixed_source"), part("badparts"), part("goodparts"), context)
    return out.withColumn("group_id", group_id(F.col("dataset"), F.col("mode"), F.col("repo"), F.col("commit_id")))


def corpus_chunks(rows: DataFrame, order: list[str], text: Column, size: int = 200) -> DataFrame:
    """``chunk, n_tokens, text_sha``: lower-case tokens over all rows in order, cut every ``size`` tokens; the last chunk may be short.

    Null keys come first; rows with equal keys are in the order of a hash of their tokens. Rows
    get their place from running sums over ranges: no sort of all tokens in one task.
    """
    t = rows.select(*order, tokens(F.lower(text)).alias("t")).withColumn("n", F.size("t")).where("n > 0")
    placed = running_before(t, [*map(F.col, order), F.xxhash64("t")], F.col("n"), "at").select("at", "t", "n")
    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size)
    pieces = placed.select("at", "t", F.explode(F.sequence(first, last)).alias("chunk"))
    lo = F.greatest(F.col("chunk") * size - F.col("at"), F.lit(0)).cast("int")
    hi = F.least((F.col("chunk") + 1) * size - F.col("at"), F.size("t")).cast("int")
    cut = pieces.select("chunk", "at", F.slice("t", lo + 1, hi - lo).alias("p"))
    joined = cut.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("ps"))
    return joined.select("chunk", F.flatten("ps.p").alias("p")).select("chunk", F.size("p").alias("n_tokens"), F.sha2(F.array_join("p", " "), 256).alias("text_sha"))
