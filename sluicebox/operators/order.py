"""Places in a total order of all rows, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.sources.shared import written


def running_before(rows: DataFrame, order: list[Column], weight: Column, name: str = "before") -> DataFrame:
    """The rows with the sum of the weights of all rows before them in the order, which must be total for a stable result.

    Rows are parted by ranges of the whole order, so that many equal first keys (nulls, too) are
    spread, and written once: the ranges don't change any more. A number per range gives the base.
    """
    placed = rows.select("*", weight.cast("bigint").alias("_w"), F.struct(*order).alias("_o"))
    # A struct sorts by its fields, nulls first.
    placed = written(placed.repartitionByRange("_o").sortWithinPartitions("_o").withColumn("_part", F.spark_partition_id()), "ordered")
    totals = {r[0]: r[1] for r in placed.groupBy("_part").agg(F.sum("_w")).collect()}  # a number per range
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + (totals[part] or 0)
    bases = placed.sparkSession.createDataFrame(sorted(base.items()) or [(0, 0)], "_part int, _base bigint")
    inner = F.coalesce(F.sum("_w").over(Window.partitionBy("_part").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.join(F.broadcast(bases), "_part").withColumn(name, inner + F.col("_base"))
    return out.drop("_w", "_o", "_part", "_base")
