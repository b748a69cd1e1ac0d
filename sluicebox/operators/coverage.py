"""How far a plan covers the contexts: marginals with zeros, counts by context, what nothing covers, whether targets are met."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.registry import FIELDS, tuples


def marginals(counts: DataFrame) -> DataFrame:
    """``mode, field, value, n`` of counts by context; every value that a context of the mode can have is there."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("p")
    return counts.select("mode", "n", pairs).groupBy("mode", "p.field", "p.value").agg(F.sum("n").alias("n"))


def tuple_counts(existing: DataFrame, planned: DataFrame, accepted: DataFrame, profile: str = "compact") -> DataFrame:
    """``mode, fields, existing, planned, accepted, total`` of each achievable context; total is existing and accepted."""
    out = tuples(existing.sparkSession, profile)
    for name, rows in (("existing", existing), ("planned", planned), ("accepted", accepted)):
        out = out.join(rows.groupBy("mode", *FIELDS).agg(F.count("*").alias(name)), ["mode", *FIELDS], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("total", F.col("existing") + F.col("accepted"))


def uncovered_contexts(counts: DataFrame) -> DataFrame:
    return counts.where("total = 0").select("mode", *FIELDS)


def plan_summary(existing: DataFrame, planned: DataFrame, accepted: DataFrame, profile: str = "compact") -> DataFrame:
    """A row per mode: ``mode, target, existing, planned, accepted, total, target_met, uncovered_contexts, uncovered_values``.

    The target is what exists and is planned. Records that fit no achievable context count for
    the mode, but for none of its contexts.
    """
    counts = tuple_counts(existing, planned, accepted, profile)
    per = counts.groupBy("mode").agg(F.count_if(F.col("total") == 0).alias("uncovered_contexts"))
    empty = marginals(counts.select("mode", *FIELDS, F.col("total").alias("n"))).where("n = 0")
    values = empty.groupBy("mode").agg(F.array_sort(F.collect_list(F.concat_ws("=", "field", "value"))).alias("v"))
    for name, rows in (("existing", existing), ("planned", planned), ("accepted", accepted)):
        per = per.join(rows.groupBy("mode").agg(F.count("*").alias(name)), "mode", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    per = per.join(values, "mode", "left")
    target, total = F.col("existing") + F.col("planned"), F.col("existing") + F.col("accepted")
    return per.select("mode", target.alias("target"), "existing", "planned", "accepted", total.alias("total"), (total >= target).alias("target_met"), "uncovered_contexts", F.coalesce(F.array_join("v", ","), F.lit("")).alias("uncovered_values"))


def performance(outcomes: DataFrame, seconds: float, workers: int) -> dict[str, float | int]:
    """Throughput of a run over ``attempts, accepted_attempt`` of its slots."""
    r = outcomes.agg(F.coalesce(F.sum("attempts"), F.lit(0)).alias("a"), F.count("accepted_attempt").alias("k")).first()
    elapsed = max(seconds, 0.001)
    rate = lambda n: round(n * 60 / elapsed, 3)
    return {"workers": workers, "attempts": r["a"], "accepted": r["k"], "rejected": r["a"] - r["k"], "elapsed_seconds": round(elapsed, 3), "accepted_per_minute": rate(r["k"]), "attempts_per_minute": rate(r["a"])}
