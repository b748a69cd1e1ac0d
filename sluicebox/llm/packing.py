"""Concatenate and cut: token windows of fixed length over the whole corpus.

Texts are encoded once into a table in the shared folder. Range buckets of the order key stand
for the partitions (an id with more tokens than a bucket is cut further, by the hash of its
texts, and a text that is repeated as often, by its rows): the first pass sums each bucket's tokens, and prefix sums over these few
totals give every bucket its global offset; the second pass brings each bucket into one task,
in order, and cuts. A window that lies within one bucket leaves the task whole; the head and
tail of a bucket leave as boundary records, which alone are grouped by window afterwards.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import digest, narrow, text_slices, written
from sluicebox.llm.histsort import splitters
from sluicebox.llm.tokenizers import DEFAULT_PATH, encoding, load_ranks

WINDOW = 2048
#: Tokens that a bucket of the second pass should hold.
BUCKET_TOKENS = 4_000_000

_LEAST = -(1 << 63)
_WIN = "at bigint, window_id bigint, n_tokens int, doc_ids array<bigint>, starts array<bigint>, ends array<bigint>, tokens array<int>"
_OUT = pa.schema([("at", pa.int64()), ("window_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int32()))])


def _encode(sent):  # noqa: ANN001, ANN202
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = sent.value
        codec, end = encoding(ranks), len(ranks)
        for batch in text_slices(batches):
            ids = [np.asarray([*codec.encode_ordinary(t), end] if t else [], dtype="<u4" if end > 65535 else "<u2") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "digest", "n", "ids"])

    return encode


def _cutter(sent, window: int, width: int, boundary: bool):  # noqa: ANN001, ANN202
    """Cuts a bucket's stream: its whole windows, or (boundary) what it holds of windows that it shares."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, totals, grand = sent.value
        at, stop = None, 0
        tokens: list[np.ndarray] = []
        segs: list[tuple] = []
        out: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            cols = list(zip(*out))
            flat = np.concatenate(cols[6])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in cols[6]])], pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), *(pa.array(cols[i], pa.list_(pa.int64())) for i in (3, 4, 5)), lists], schema=_OUT)
            out.clear()

        def close() -> None:
            nonlocal tokens, segs, size
            first = at - size
            number = first // window
            whole = size == min(window, grand - number * window)
            if size and whole != boundary:
                held = np.concatenate(tokens)
                out.append((first, number, size, [s[0] for s in segs], [s[1] for s in segs], [s[2] for s in segs], held))
            tokens, segs, size = [], [], 0

        for batch in batches:
            for bucket, doc_id, n, raw in zip(*(batch.column(x).to_pylist() for x in ("bucket", "doc_id", "n", "ids"))):
                if at is None:
                    at = offsets[bucket]
                    stop = at + totals[bucket]
                ids = np.frombuffer(raw, dtype=f"<u{width}")
                start = 0
                while start < n:
                    take = min(n - start, window - at % window)
                    tokens.append(ids[start : start + take])
                    segs.append((doc_id, start, start + take))
                    size += take
                    start += take
                    at += take
                    if at % window == 0 or at == stop:
                        close()
                        if len(out) >= 64:
                            yield from flush()
        if out:
            yield from flush()

    return cut


Cut = tuple[int, bool, int, int]


def cuts(coded: DataFrame, key: Column, buckets: int, bucket_tokens: int) -> list[Cut]:
    """The buckets' least rows but for the first bucket's, as (key, whether the id is known, digest, hash of the row)."""
    bounds, _, _ = splitters(coded.select(key.alias("k"), F.col("n").alias("w")), buckets, tolerance=0.1)
    times = Counter([*map(int, bounds), *[1 << 63] * (buckets - 1 - len(bounds))])
    spread = lambda m: (_LEAST + j * (1 << 64) // m for j in range(1, m))
    found: list[Cut] = [(b, False, _LEAST, _LEAST) for b in times]
    # A key that holds several targets is heavier than a bucket: as many further cuts, evenly over its digests.
    heavy = {b - 1: n for b, n in times.items() if n > 1}
    for k, n in heavy.items():
        found += [(k, known, d, _LEAST) for known in _known(k) for d in (_LEAST, *spread(n + 1))]
    if heavy:
        same = coded.where(key.isin(list(heavy))).groupBy(key.alias("k"), "digest").agg(F.sum("n").alias("w")).where(F.col("w") > bucket_tokens)
        for k, d, w in same.collect():  # each is a bucket or more
            found += [(k, known, d, r) for known in _known(k) for r in spread(-(-w // bucket_tokens))]
    return sorted(set(found))


def _known(k: int) -> tuple[bool, ...]:
    """The least key stands for null, too."""
    return (True,) if k > _LEAST else (False, True)


def _bucket(sent, key: Column) -> Column:  # noqa: ANN001
    @F.pandas_udf("int")
    def find(k: pd.Series, known: pd.Series, d: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(sent.value, x) for x in zip(k.tolist(), known.tolist(), d.tolist(), r.tolist())], dtype="int32")

    return find(key, F.col("doc_id").isNotNull(), F.col("digest"), F.col("row"))


def pack(docs: DataFrame, window: int = WINDOW, path: str = DEFAULT_PATH, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """One row per window: ``window_id, n_tokens, doc_ids, starts, ends, tokens``.

    The corpus is the concatenation of the documents' tokens in the order of doc_id (null
    first) and a hash of the text, each followed by an end token (the id after the vocabulary's last).
    Window w holds tokens [w * window, (w + 1) * window); only the last can be shorter. The
    boundary records ``doc_ids[i], starts[i], ends[i]`` say which tokens of which document stand
    in it, in order. Documents with null or empty text give no tokens; repeated rows are packed
    each time; a long document runs over as many windows as it needs; an empty table gives no
    windows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    ranks = load_ranks(path)
    sent = spark.sparkContext.broadcast(ranks)  # the vocabulary's size, whatever the corpus
    rows = narrow(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("digest", digest())
    coded = written(rows.mapInArrow(_encode(sent), "doc_id bigint, digest bigint, n bigint, ids binary").where("n > 0").withColumn("row", F.xxhash64(F.monotonically_increasing_id())), "tokens")
    key = F.coalesce(F.col("doc_id"), F.lit(_LEAST).cast("bigint"))
    grand = coded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-grand // bucket_tokens))
    found = cuts(coded, key, buckets, bucket_tokens)
    buckets = len(found) + 1
    placed = coded.withColumn("bucket", _bucket(spark.sparkContext.broadcast(found), key))  # a few numbers a bucket
    totals = [0] * buckets
    for bucket, total in placed.groupBy("bucket").agg(F.sum("n")).collect():  # a number per bucket
        totals[bucket] = total
    offsets = [int(x) for x in np.r_[0, np.cumsum(totals)[:-1]]]
    plan = spark.sparkContext.broadcast((offsets, totals, grand))
    ordered = placed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "digest", "row")
    width = 4 if len(ranks) > 65535 else 2
    # Both branches read the same exchange; the second one keeps only what straddles buckets.
    whole = ordered.mapInArrow(_cutter(plan, window, width, False), _WIN)
    parts = ordered.mapInArrow(_cutter(plan, window, width, True), _WIN)
    part = F.struct("at", "n_tokens", "doc_ids", "starts", "ends", "tokens")
    edge = parts.groupBy("window_id").agg(F.array_sort(F.collect_list(part)).alias("p"))  # a window's tokens at most
    edge = edge.select("window_id", F.aggregate("p.n_tokens", F.lit(0), lambda s, x: s + x).alias("n_tokens"), *[F.flatten(f"p.{n}").alias(n) for n in ("doc_ids", "starts", "ends", "tokens")])
    return whole.drop("at").unionByName(edge)
