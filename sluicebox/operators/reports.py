"""Counting reports in long form; JSON and rounding are for the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.functions.safe import truthy
from sluicebox.operators.order import running_before


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``field, value, n`` of each column, empty values as unknown, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), truthy(F.col(c).cast("string"), "unknown").alias("value")) for c in columns])).alias("p")
    return rows.select(pairs).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, known: DataFrame, mode: str, fields: list[str]) -> DataFrame:
    """``mode, field, value, n``: per mode its total, each field's values and the full contexts joined by |.

    Known modes without rows have a total of 0; unknown modes with rows are kept.
    """
    vals = [truthy(F.col(f).cast("string"), "unknown") for f in fields]
    entries = [F.struct(F.lit("total").alias("field"), F.lit("").alias("value")), *[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in zip(fields, vals)], F.struct(F.lit("context").alias("field"), F.concat_ws("|", *vals).alias("value"))]
    counted = rows.select(F.col(mode).alias("mode"), F.explode(F.array(*entries)).alias("p")).groupBy("mode", "p.field", "p.value").agg(F.count("*").alias("n"))
    zero = known.select("mode").join(rows.select(F.col(mode).alias("mode")).distinct(), "mode", "left_anti").select("mode", F.lit("total").alias("field"), F.lit("").alias("value"), F.lit(0).cast("bigint").alias("n"))
    return counted.unionByName(zero)


def uncovered(grid: DataFrame, rows: DataFrame, mode: str, field: str) -> DataFrame:
    """Allowed values of a field that no row of the mode has."""
    return grid.select(mode, field).distinct().join(rows.select(mode, field).distinct(), [mode, field], "left_anti")


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once; unknown and empty ones aside."""
    return rows.where(~truthy(F.col(key).cast("string"), "unknown").isin("unknown")).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def row_index(rows: DataFrame, mode: str, order: str) -> DataFrame:
    """The rows with ``row_index``, their place within the mode, from 1; rows equal in both keys are in no certain order.

    Only the keys are put in order, over ranges of them; the rows meet their place by a join, so that no task
    gets all rows of a mode.
    """
    keys = rows.groupBy(F.col(mode).alias("_m"), F.col(order).alias("_k")).agg(F.count("*").alias("_n"))
    placed = running_before(keys, [F.col("_m"), F.col("_k")], F.col("_n"), "_at")
    first = placed.groupBy(F.col("_m").alias("_of")).agg(F.min("_at").alias("_first"))
    places = placed.join(first, F.col("_m").eqNullSafe(F.col("_of"))).select("_m", "_k", (F.col("_at") - F.col("_first") + 1).alias("_place"))
    own = F.col("_place")
    if placed.where("_n > 1").limit(1).count():
        own = own + F.row_number().over(Window.partitionBy("_m", "_k").orderBy("_place")) - 1
    joined = rows.join(places, F.col(mode).eqNullSafe(F.col("_m")) & F.col(order).eqNullSafe(F.col("_k")))
    return joined.withColumn("row_index", own.cast("int")).drop("_m", "_k", "_place")


def last_wins(rows: DataFrame, key: str, order: str, kept: list[str]) -> DataFrame:
    """The last row, by order, of each key: one aggregate, no sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*kept), order).alias("r")).select(key, "r.*")


def difference(left: DataFrame, right: DataFrame, keys: list[str], body: Column, label: str = "state") -> DataFrame:
    """Keys whose bodies differ or that one side lacks: missing, extra or changed."""
    a = left.select(*keys, body.alias("_a")).withColumn("_in_a", F.lit(True))
    b = right.select(*keys, body.alias("_b")).withColumn("_in_b", F.lit(True))
    j = a.join(b, keys, "full")
    state = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.withColumn(label, state).where(F.col(label).isNotNull()).select(*keys, label)


def nested(rows: list[tuple[str, str, int]]) -> dict[str, dict[str, int]]:
    """Long-form counts (field, value, n) as the nested dictionary of a report."""
    out: dict[str, dict[str, int]] = {}
    for field, value, n in rows:
        out.setdefault(field, {})[value] = n
    return out
