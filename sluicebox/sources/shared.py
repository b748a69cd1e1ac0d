"""Tables in the folder that all executors share: where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary folder; a cluster gets an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sluicebox-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """The same rows in as many partitions as there are cores, where the files have fewer splits (a small table in one row group); else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a table in the shared folder, which the loss of an executor doesn't touch."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`written` made and that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark).split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        if path.toUri().getPath().startswith(root):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
