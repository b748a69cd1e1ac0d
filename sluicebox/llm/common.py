"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")

#: Characters of text that one slice of an Arrow batch holds at most (a longer text is a slice of its own).
SLICE_CHARS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster gets an error, as
    its machines don't see each other's folders.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sluicebox-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: lineage ends there, and the loss of an executor loses nothing."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The same rows in as many partitions as there are cores, where the files have fewer splits (a small table in one row group); else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`written` made and that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark).split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        if path.toUri().getPath().startswith(root):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices (without copying) of at most SLICE_CHARS bytes of text, so that a worker's memory doesn't follow the batch size."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for at, length in enumerate(lengths):
            if at > start and total + length > SLICE_CHARS:
                yield batch.slice(start, at - start)
                start, total = at, 0
            total += length
        if len(lengths) > start:
            yield batch.slice(start)


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns; extra columns, whatever their names, don't reach the operator."""
    return df.select(*[F.col(f"`{x}`") for x in names])


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, for working columns beside extra columns of the caller."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def digest() -> Column:
    """64 bits of doc_id and text: tells apart rows that share only one of them. Rows equal in both are one document."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text"))
