"""Accepted records validated anew: what stays, what is set aside and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.registry import MODES
from sluicebox.functions.safe import truthy
from sluicebox.operators.policy import review_passed, revalidation_category
from sluicebox.operators.validation import validate

LOST = "the record could not be reconstructed"
UNREVIEWED = "no passing verdict of a reviewer"


def revalidate(records: DataFrame, strict: bool = False) -> DataFrame:
    """The records with their new ``validation``, ``reject_reason`` and ``revalidation`` (null for those that stay).

    The profile is the record's own. A record without a known class, context, sample index or code
    can't be reconstructed: that is its only reason but for a missing review. The tools' runs are
    those of the record.
    """
    c = F.col("context")
    known = F.coalesce(F.coalesce(F.nullif(c["cwe_key"], F.lit("")), F.col("mode")).isin(MODES), F.lit(False))
    whole = known & c["sample_index"].isNotNull() & F.col("vulnerable_code").isNotNull() & F.col("fixed_code").isNotNull()
    for f in ("application_type", "flow_pattern", "difficulty", "structure"):
        whole = whole & c[f].isNotNull()
    none = F.array().cast("array<string>")
    rows = validate(records.withColumn("_whole", F.coalesce(whole, F.lit(False))), strict)
    reviewed = F.coalesce(F.col("review")["required"], F.lit(False)) & review_passed(F.col("review"))
    why = F.concat(F.when(F.col("_whole"), F.col("validation")["reasons"]).otherwise(F.array(F.lit(LOST))), F.when(reviewed, none).otherwise(F.array(F.lit(UNREVIEWED))))
    rows = rows.withColumn("_why", why)
    v = F.col("validation").withField("reasons", F.col("_why")).withField("passed", F.size("_why") == 0)
    gone = F.size("_why") > 0
    mark = F.struct(truthy(F.col("id"), "unknown").alias("source_id"), F.lit("quarantined").alias("status"), F.array_sort(F.array_distinct(F.transform("_why", revalidation_category))).alias("reason_categories"))
    return rows.withColumn("validation", v).withColumn("reject_reason", F.when(gone, F.col("_why")).otherwise(F.col("reject_reason"))).withColumn("revalidation", F.when(gone, mark)).select(*records.columns)


def summary(results: DataFrame) -> DataFrame:
    """``section, key, value``: records, those that stay and those set aside, by mode, and the categories, each once a record."""
    gone = F.col("revalidation").isNotNull()
    mode = F.coalesce(F.nullif(F.col("context")["mode"], F.lit("")), truthy(F.col("mode"), "unknown"))
    state = F.when(gone, "quarantined").otherwise("retained")
    entry = lambda s, k: F.struct(s.alias("section"), k.alias("key"))
    cats = F.transform(F.coalesce(F.col("revalidation")["reason_categories"], F.array().cast("array<string>")), lambda x: entry(F.lit("reason_categories"), x))
    pairs = F.explode(F.concat(F.array(entry(F.lit("total"), F.lit("source_accepted")), entry(F.lit("total"), state), entry(F.concat(state, F.lit("_by_mode")), mode)), cats)).alias("p")
    return results.select(pairs).groupBy("p.section", "p.key").agg(F.count("*").alias("value"))
