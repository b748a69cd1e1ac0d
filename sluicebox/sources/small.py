"""Small files: reports and metrics, on whatever file system their path names."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, on whatever file system the path names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as one text; null where it isn't there."""
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def write_report(spark: SparkSession, report: object, path: str) -> None:
    """A small report as JSON with sorted keys, indented by 2."""
    write_text(spark, path, json.dumps(report, indent=2, sort_keys=True) + "\n")


def copy_report(spark: SparkSession, source: str, target: str) -> bool:
    """Copies a report as it is, if it is there; whether it says pass isn't looked at."""
    text = read_text(spark, source)
    if text is not None:
        write_text(spark, target, text)
    return text is not None
