"""Line deduplication that returns keep bitmaps instead of text.

Every line is hashed (128 bits, exact for practical purposes); the hashes are range-partitioned
and sorted by hash, document and position, and one streaming pass over each partition keeps the
first occurrence. Text never enters that exchange. A line that occurs often is first reduced
within each Arrow batch (only the batch's first occurrence can be the corpus's first), so a hot
hash puts at most one row per batch in its range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.functions.text import let
from sluicebox.llm.common import digest, narrow, text_slices, unused

_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("pos", pa.int32())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])


def _hash(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        raw, ids, digests, pos = [], [], [], []
        for doc_id, text, sha in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text", "digest"))):
            for at, line in enumerate(text.split("\n")):
                line = line.strip()
                if line:
                    raw.append(_hash(line))
                    ids.append(doc_id)
                    digests.append(sha)
                    pos.append(at)
        if not raw:
            continue
        h = np.frombuffer(b"".join(raw), dtype="<i8").reshape(-1, 2)
        known = np.array([x is not None for x in ids])
        key = np.array([0 if x is None else x for x in ids], dtype=np.int64)
        d, p = np.array(digests, dtype=np.int64), np.array(pos, dtype=np.int32)
        order = np.lexsort((p, d, key, known, h[:, 1], h[:, 0]))
        s = h[order]
        first = order[np.r_[True, (s[1:] != s[:-1]).any(axis=1)]]
        yield pa.RecordBatch.from_arrays([pa.array(h[first, 0]), pa.array(h[first, 1]), pa.array(key[first], mask=~known[first]), pa.array(d[first]), pa.array(p[first])], schema=_LINES)


def _stream_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        new = np.r_[before != (h1[0], h2[0]), (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        before = (h1[-1], h2[-1])
        kept = batch.filter(pa.array(new))
        if kept.num_rows:
            yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("digest"), kept.column("pos"), pa.nulls(kept.num_rows, pa.int32())], schema=_KEPT)


def line_keep_bitmaps(docs: DataFrame) -> DataFrame:
    """One row per document with text: ``doc_id, digest, n_lines, n_kept, keep_runs``.

    ``keep_runs`` is the keep bitmap over the document's lines (split at LF), compressed to run
    lengths: kept, dropped, kept, ... beginning with a kept run, which may be 0. A line is
    dropped when an equal line (white space around it aside) stands earlier in the order of
    doc_id (null first), digest and position, in this or any other document. Blank lines are
    always kept. A document with null text has no row; an empty text is one blank line, "1".
    Rows that share doc_id and text are one document; rows that share only doc_id are told apart
    by ``digest`` (a 64-bit hash of both). Extra columns are ignored.
    """
    rows = narrow(docs, "doc_id", "text").where("text is not null").withColumn("digest", digest())
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    hashed = rows.mapInArrow(_hash_lines, "h1 bigint, h2 bigint, doc_id bigint, digest bigint, pos int")
    # Hashes are even over their range, so equal ranges are the splitters: nothing is sampled.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.least(F.floor((F.col("h1") / F.lit(2.0**64) + 0.5) * parts), F.lit(parts - 1)).cast("int")
    exchanged = hashed.repartitionById(parts, at).sortWithinPartitions("h1", "h2", F.col("doc_id").asc_nulls_first(), "digest", "pos")
    first = exchanged.mapInArrow(_stream_first, "doc_id bigint, digest bigint, pos int, n_lines int")
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", "") == "")
    whole = rows.select("doc_id", "digest", F.size(lines).alias("n_lines"), F.filter(F.transform(lines, lambda x, i: F.when(x, i)), lambda x: x.isNotNull()).alias("blank"))
    whole = whole.select("doc_id", "digest", F.lit(None).cast("int").alias("pos"), "n_lines", "blank")
    first = first.withColumn("blank", F.lit(None).cast("array<int>"))
    grouped = first.unionByName(whole).groupBy("doc_id", "digest").agg(F.collect_list("pos").alias("pos"), F.max("n_lines").alias("n_lines"), F.max("blank").alias("blank"))
    kept = F.array_sort(F.array_distinct(F.concat("pos", "blank")))
    # Run ends: a kept position whose successor isn't kept; run starts: one whose predecessor isn't.
    n, k = F.col("n_lines"), F.col("kept")
    runs = grouped.withColumn("kept", kept).withColumn("gap", F.transform(k, lambda p, i: p - F.when(i == 0, F.lit(-1)).otherwise(F.get(k, i - 1)) - 1))
    starts = F.filter(F.transform("gap", lambda g, i: F.when((g > 0) | (i == 0), i)), lambda x: x.isNotNull())
    runs = runs.withColumn("starts", starts)
    s = F.col("starts")
    each = F.flatten(F.transform(s, lambda b, j: F.filter(F.array(
        F.when((j > 0) | (F.get("gap", b) > 0), F.get("gap", b)),
        F.coalesce(F.get(s, j + 1), F.size(k)) - b,
    ), lambda x: x.isNotNull())))
    lead = F.when((F.size(k) == 0) | (F.get(k, F.lit(0)) > 0), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    tail = n - F.when(F.size(k) == 0, F.lit(0)).otherwise(F.element_at(k, -1) + 1)
    rest = F.when(tail > 0, F.array(tail)).otherwise(F.array().cast("array<int>"))
    each = F.when(F.size(k) == 0, F.array().cast("array<int>")).otherwise(each)
    return runs.select("doc_id", "digest", n, F.size(k).alias("n_kept"), F.concat_ws(",", F.transform(F.concat(lead, each, rest), lambda x: x.cast("string"))).alias("keep_runs"))


def apply_line_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with only their kept lines, all columns as they came.

    A document of which no line but blank ones is left goes, unless it had none before. Null
    texts stay null. Of rows equal in doc_id and text one is left (the first in the order of
    their other columns' JSON). ``n_chars``, where there is one, follows the text.
    """
    digest_, runs_, order_ = (unused(docs, x) for x in ("digest", "keep_runs", "rank"))
    id_ = unused(docs, "bitmap_id")
    marks = bitmaps.select(F.col("doc_id").alias(id_), F.col("digest").alias(digest_ + "_b"), F.col("keep_runs").alias(runs_))
    base = docs.withColumn(digest_, digest())
    # Not an equi-join key: the digest alone partitions both the join and the ranking below.
    same = (F.col("doc_id") == F.col(id_)) | (F.col("doc_id").isNull() & F.col(id_).isNull())
    joined = base.join(marks, (F.col(digest_) == F.col(digest_ + "_b")) & same, "left")
    bounds = F.aggregate(
        F.split(runs_, ","),
        F.struct(F.lit(0).alias("at"), F.lit(True).alias("keep"), F.array().cast("array<struct<a:int,n:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x.cast("int")).alias("at"),
            (~acc["keep"]).alias("keep"),
            F.when(acc["keep"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), x.cast("int").alias("n"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    kept = lambda lines: F.flatten(F.transform(bounds, lambda b: F.slice(lines, b["a"] + 1, b["n"])))
    text = F.array_join(let(F.split("text", "\n", -1), kept), "\n")
    out = joined.withColumn(order_, F.col("text")).withColumn("text", F.when(F.col(runs_).isNull(), F.col("text")).otherwise(F.when(~F.contains(runs_, F.lit(",")), F.col("text")).otherwise(text)))
    blank = lambda c: F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", "") == ""
    out = out.where(F.col("text").isNull() | ~blank(F.col("text")) | blank(F.col(order_)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    out = out.select(*[F.col(f"`{x}`") for x in docs.columns], digest_)
    # Equal rows are one document: the join has already brought them together.
    rank = F.row_number().over(Window.partitionBy("doc_id", digest_).orderBy(F.to_json(F.struct(*[F.col(f"`{x}`") for x in docs.columns if x != "text"]))))
    out = out.withColumn(order_, rank)
    return out.where((F.col(order_) == 1) | F.col("text").isNull()).select(*[F.col(f"`{x}`") for x in docs.columns])
