"""Records that arrive as a stream, decided by the duplicate policy against what was accepted before.

The stored index is the accepted log itself: each batch is decided with the accepted rows pinned,
and its decisions are appended under the batch's number. A batch that is run again after a failure
overwrites its own part, so each record is decided once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sluicebox.operators.verify import duplicate_decisions
from sluicebox.sources.files import RECORD
from sluicebox.sources.small import exists


def read_stream(spark: SparkSession, folder: str, schema: str = RECORD) -> DataFrame:
    """Lines of JSON from the files that arrive in a folder."""
    return spark.readStream.schema(schema).json(folder)


def accepted_before(spark: SparkSession, index: str, batch: int, schema) -> DataFrame:  # noqa: ANN001
    """The accepted rows of earlier batches."""
    if not exists(spark, index):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema.add("batch", "long").add("accepted", "boolean")).parquet(index).where((F.col("batch") < batch) & F.col("accepted")).drop("batch", "accepted")


def decide(records: DataFrame, before: DataFrame) -> DataFrame:
    """The records with ``accepted, check, matched, similarity``; ``before`` was accepted earlier and isn't checked again."""
    both = records.withColumn("_pinned", F.lit(False)).unionByName(before.withColumn("_pinned", F.lit(True)))
    return records.join(duplicate_decisions(both, "_pinned"), "ord")


def intake(stream: DataFrame, index: str, checkpoint: str) -> DataStreamWriter:
    """A writer that decides each batch of the stream and stores it in ``index``, partitioned by batch; start it with a trigger.

    ``ord`` must be unique over the whole stream and say the order of arrival.
    """

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        from pyspark.sql.types import StructType

        schema = StructType(list(rows.schema.fields))
        decided = decide(rows, accepted_before(spark, index, batch, schema))
        decided.drop("check", "matched", "similarity").write.mode("overwrite").parquet(f"{index}/batch={batch}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
