"""Histogram sort: byte-balanced range shards found by probing, then one exchange.

The driver keeps, for each splitter, the key interval that must hold it. A round puts a few
probes into each open interval, counts the exact bytes below every probe over all partitions
(each task returns one small histogram), and narrows the intervals, until every splitter is
within the tolerance of its target or its interval holds a single key. Only then do the rows move,
once, straight to their shard.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import unused, written

SHARDS = 64
TOLERANCE = 0.0
PROBES = 32


def hash_key(column: str) -> Column:
    """60 bits of the MD5 of a column's decimal or text form: a key for globally shuffled shards. Null has the key of ''."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def _histogram(probes):  # noqa: ANN001, ANN202
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = probes.value
        total = np.zeros(len(edges) + 1, dtype=np.int64)
        for batch in batches:
            at = np.searchsorted(edges, batch.column("k").to_numpy(), side="right")
            np.add.at(total, at, batch.column("w").to_numpy())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["slot", "w"])

    return count


def splitters(sized: DataFrame, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> tuple[np.ndarray, int, int]:
    """Splitters of ``k bigint, w bigint`` (no nulls), the total weight, and the rounds.

    Splitter i is the least key found such that the weight of smaller keys is at least i / shards
    of the whole, off by at most ``tolerance`` of a shard's share; with tolerance 0 it is the
    least such key at all. Rows of equal keys are never parted, however heavy; then shards can
    be empty. A shard holds its splitter's key and the keys up to the next splitter. Splitters
    above the greatest bigint, which no key reaches, are left out. An empty table has splitters of 0.
    """
    low, high, total = sized.agg(F.min("k"), F.max("k"), F.sum("w")).first()
    if low is None:
        return np.zeros(shards - 1, dtype=np.int64), 0, 0
    targets = [i * total / shards for i in range(1, shards)]
    slack = tolerance * total / shards
    # below(lo) < target <= below(hi) for each splitter, where below(k) is the weight of keys < k.
    lo, hi = [low] * (shards - 1), [high + 1] * (shards - 1)
    below_hi = [total] * (shards - 1)
    rounds = 0
    while True:
        wanted: set[int] = set()
        for i in range(shards - 1):
            if hi[i] - lo[i] > 1 and below_hi[i] - targets[i] > slack:
                gap = hi[i] - lo[i]
                wanted.update(lo[i] + gap * j // (probes + 1) for j in range(1, probes + 1))
                wanted.discard(lo[i])
        if not wanted:
            return np.array([x for x in hi if x < 1 << 63], dtype=np.int64), total, rounds
        rounds += 1
        edges = sorted(wanted)
        spark = sized.sparkSession
        sent = spark.sparkContext.broadcast(np.array(edges, dtype=np.int64))  # shards * probes numbers at most
        found = sized.mapInArrow(_histogram(sent), "slot bigint, w bigint").groupBy("slot").agg(F.sum("w").alias("w")).collect()
        counts = np.zeros(len(edges) + 1, dtype=np.int64)
        for slot, w in found:
            counts[slot] = w
        below = np.cumsum(counts)[:-1]  # weight of keys < edges[j]: slots up to j
        for i in range(shards - 1):
            if not (hi[i] - lo[i] > 1 and below_hi[i] - targets[i] > slack):
                continue
            a, b = bisect_right(edges, lo[i]), bisect_left(edges, hi[i])
            j = a + int(np.searchsorted(below[a:b], targets[i], side="left"))
            if j < b:
                hi[i], below_hi[i] = edges[j], int(below[j])
            if j > a:
                lo[i] = edges[j - 1]


def shard_of(bounds: np.ndarray, key: Column) -> Column:
    """The shard of each key: the number of splitters not above it."""

    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="right").astype(np.int32))

    return find(key)


def histogram_sort(df: DataFrame, key: Column, shards: int = SHARDS, tolerance: float = TOLERANCE, probes: int = PROBES, size_column: str = "text") -> DataFrame:
    """All rows and columns, with ``shard_key`` and ``shard``: partition i of the result is shard i, sorted by key.

    The key is a bigint; null keys sort first, as the least bigint. A row weighs the bytes of
    ``size_column`` plus one, so that rows with empty or null text are spread too. Rows of equal
    key are kept together and ordered by no further column. An empty table gives no rows. Columns
    of the input named ``shard_key`` or ``shard`` are kept; then the new ones get leading underscores.
    """
    k, s = unused(df, "shard_key"), unused(df, "shard")
    keyed = df.withColumn(k, F.coalesce(key, F.lit(-(1 << 63)).cast("bigint")))
    # Keys and sizes once, in a narrow table: the rounds don't read the texts again.
    sized = written(keyed.select(F.col(k).alias("k"), (F.coalesce(F.octet_length(size_column), F.lit(0)) + 1).cast("bigint").alias("w")), "sizes")
    bounds, _, _ = splitters(sized, shards, tolerance, probes)
    return keyed.withColumn(s, shard_of(bounds, F.col(k))).repartitionById(shards, F.col(s)).sortWithinPartitions(k)
