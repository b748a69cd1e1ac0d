"""Benchmark decontamination by normalised word n-grams.

The n-grams of all benchmark items form a hash set. While it is small (its size is checked) it
is broadcast and each document's token windows are tested against it in one narrow pass, which
also cuts the text: no row is exchanged. Beyond that size the documents' window hashes (without
words) are joined with the set's by a shuffle, and only documents with a hash hit are met again
with their text. Both ways verify a hash hit word by word and give the same hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import SLICE_CHARS, WORD, digest, narrow, text_slices, unused, written

#: Words of a window; an item of fewer words is one window of its own length.
NGRAM = 8
#: Share of contaminated words from which on the whole document goes.
DROP_SHARE = 0.5
#: Bytes of benchmark text up to which the n-gram set is broadcast.
BROADCAST_BYTES = 32 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15)
_HITS = "doc_id bigint, digest bigint, n_words int, hit_words int, n_spans int, n_items int, spans array<struct<a:int,b:int>>"
_SPAN = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def words_of(text: str | None) -> list[str]:
    """The words in lower case, as many as the text itself has: a letter whose lower case is two characters doesn't shift them."""
    if not text:
        return []
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


class NgramSet:
    """Benchmark windows by length: sorted hashes, the words' ids for verification, and the items of each window."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        self.vocabulary: dict[str, int] = {}
        grams: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for at, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(n, len(ids))
            for j in range(len(ids) - size + 1 if size else 0):
                grams.setdefault(size, {}).setdefault(tuple(ids[j : j + size]), set()).add(at)
        self.tables = {}
        for size, found in grams.items():
            keys = np.array(list(found), dtype=np.int64).reshape(-1, size)
            h = rolling(keys.ravel(), size)[::size] if len(keys) else np.zeros(0, np.uint64)
            order = np.argsort(h, kind="stable")
            sets = list(found.values())
            self.tables[size] = (h[order], keys[order], [sorted(sets[i]) for i in order])


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of n ids."""
    m = max(0, len(ids) - n + 1)
    out = np.zeros(m, dtype=np.uint64)
    u = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ (u[k : k + m] + np.uint64(k + 1))) * _MUL
            out ^= out >> np.uint64(29)
    return out


def _find(ids: np.ndarray, grams: NgramSet) -> list[tuple[int, int, list[int]]]:
    """(start, length, items) of each verified window."""
    hits = []
    for size, (table, keys, items) in grams.tables.items():
        if len(ids) < size:
            continue
        h = rolling(ids, size)
        at = np.searchsorted(table, h)
        for j in np.flatnonzero((at < len(table)) & (table[np.minimum(at, len(table) - 1)] == h)):
            k = at[j]
            while k < len(table) and table[k] == h[j]:
                if (keys[k] == ids[j : j + size]).all():
                    hits.append((int(j), size, items[k]))
                k += 1
    return hits


def _spans(hits: list[tuple[int, int, list[int]]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for start, size, _ in sorted(hits):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], start + size)
        else:
            merged.append([start, start + size])
    return [(a, b) for a, b in merged]


def _hits_of(texts: list[str | None], table: NgramSet) -> tuple[np.ndarray, dict[int, list[tuple[int, int, list[int]]]]]:
    """The number of words of each text, and the hits of those that have any."""
    get = table.vocabulary.get
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    # All documents end to end, with a stop (0) behind each: no benchmark window holds a 0.
    ids = np.fromiter((get(w, 0) for ws in words for w in (*ws, "")), dtype=np.int64, count=int(sizes.sum()) + len(words))
    starts = np.r_[0, np.cumsum(sizes + 1)]
    by_doc: dict[int, list] = {}
    for j, size, items in _find(ids, table):
        doc = int(np.searchsorted(starts, j, side="right")) - 1
        by_doc.setdefault(doc, []).append((j - int(starts[doc]), size, items))
    return sizes, by_doc


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these word ranges, each from its first word's first character to its last word's last one."""
    at = [m.span() for m in WORD.finditer(text)]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return "".join((*out, text[end:]))


def _cleaned(grams, drop_share: float) -> Callable:  # noqa: ANN001
    @F.pandas_udf("text string, gone boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        """The text where it changes, and whether the document goes."""
        for batch in batches:
            texts = batch.tolist()
            new: list[str | None] = [None] * len(texts)
            gone = [False] * len(texts)
            start = size = 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1] or "")
                if end < len(texts) and size < SLICE_CHARS:
                    continue
                sizes, by_doc = _hits_of(texts[start:end], grams.value)
                for doc, hits in by_doc.items():
                    spans = _spans(hits)
                    if sum(b - a for a, b in spans) / sizes[doc] >= drop_share:
                        gone[start + doc] = True
                    else:
                        new[start + doc] = cut(texts[start + doc], spans)
                start, size = end, 0
            yield pd.DataFrame({"text": pd.Series(new, dtype=object), "gone": gone})

    return clean.asNondeterministic()  # so that it isn't run once for the filter and again for the text


def _scan(grams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sizes, by_doc = _hits_of(batch.column("text").to_pylist(), grams.value)
            if not by_doc:
                continue
            rows = {x.name: [] for x in _SCHEMA}
            for doc, hits in by_doc.items():
                spans = _spans(hits)
                for name, value in (("doc_id", batch.column("doc_id")[doc].as_py()), ("digest", batch.column("digest")[doc].as_py()), ("n_words", int(sizes[doc])), ("hit_words", sum(b - a for a, b in spans)), ("n_spans", len(spans)), ("n_items", len({x for h in hits for x in h[2]})), ("spans", [{"a": a, "b": b} for a, b in spans])):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=_SCHEMA)

    return scan


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n_words", pa.int32()), ("hit_words", pa.int32()), ("n_spans", pa.int32()), ("n_items", pa.int32()), ("spans", _SPAN)])


def _hash(gram: str) -> int:
    return xxhash.xxh64_intdigest(gram.encode("utf-8", "surrogatepass")) - (1 << 63)


def _grams(words: list[str], size: int) -> list[str]:
    return [" ".join(words[j : j + size]) for j in range(len(words) - size + 1)]


def _windows(sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The hash of each window of each document, for the way without a broadcast."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            for sha, text in zip(*(batch.column(x).to_pylist() for x in ("digest", "text"))):
                words = words_of(text)
                for size in sizes:
                    hashes = [_hash(g) for g in _grams(words, size)]
                    if hashes:
                        k = len(hashes)
                        yield pa.RecordBatch.from_pydict({"digest": pa.array([sha] * k, pa.int64()), "start": pa.array(range(k), pa.int32()), "size": pa.array([size] * k, pa.int32()), "h": pa.array(hashes, pa.int64())})

    return windows


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the windows whose hash was met."""
    for batch in text_slices(batches):
        for doc_id, sha, text, at in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "digest", "text", "at"))):
            words, k = words_of(text), len(at)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id] * k, pa.int64()), "digest": pa.array([sha] * k, pa.int64()), "n_words": pa.array([len(words)] * k, pa.int32()), "start": pa.array([x["start"] for x in at], pa.int32()), "size": pa.array([x["size"] for x in at], pa.int32()), "gram": [" ".join(words[x["start"] : x["start"] + x["size"]]) for x in at]})


def _items(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                size = min(n, len(words))
                grams = sorted(set(_grams(words, size))) if size else []
                if grams:
                    yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(grams), pa.int64()), "size": pa.array([size] * len(grams), pa.int32()), "gram": grams, "h": pa.array([_hash(g) for g in grams], pa.int64())})

    return items


def _merge(key: tuple, pdf):  # noqa: ANN001, ANN202
    hits = [(int(s), int(z), [i]) for s, z, i in zip(pdf["start"], pdf["size"], pdf["item"])]
    spans = _spans(hits)
    out = pdf.iloc[:1][["doc_id", "digest", "n_words"]].copy()
    out["hit_words"], out["n_spans"], out["n_items"] = sum(b - a for a, b in spans), len(spans), pdf["item"].nunique()
    out["spans"] = [[{"a": a, "b": b} for a, b in spans]]
    return out


def _broadcast(items: DataFrame, n: int, limit: int):  # noqa: ANN202
    """The broadcast n-gram set, or None where the items' text is larger than the limit."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    if size > limit:
        return None
    return items.sparkSession.sparkContext.broadcast(NgramSet([tuple(r) for r in items.orderBy("item_id", "text").toLocalIterator()], n))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per contaminated document: ``doc_id, digest, n_words, hit_words, n_spans, n_items, spans``.

    Words are runs of letters, digits and underscores of the lower-case text. A window of n
    words is a hit if a benchmark item has the same n words in a row; an item of fewer than n
    words counts as one window. ``spans`` are the maximal overlapping or adjacent hits as word
    ranges [a, b). Items or documents that are null or without words hit nothing. Equal items
    are counted once per row of the benchmark. Rows of docs equal in doc_id and text give one
    row. Extra columns are ignored.
    """
    rows = narrow(docs, "doc_id", "text").where("text is not null").withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("digest", digest())
    items = narrow(benchmark, "item_id", "text").where("text is not null")
    grams = _broadcast(items, n, broadcast_bytes)
    if grams is not None:
        found = rows.mapInArrow(_scan(grams), _HITS)
    else:
        table = items.withColumn("item", F.monotonically_increasing_id()).mapInArrow(_items(n), "item bigint, size int, gram string, h bigint")
        table = written(table, "grams")
        sizes = [r["size"] for r in table.select("size").distinct().collect()]  # at most n of them
        hashed = rows.mapInArrow(_windows(sorted(sizes)), "digest bigint, start int, size int, h bigint")
        met = hashed.join(table.select("size", "h").distinct(), ["size", "h"], "left_semi")
        near = met.groupBy("digest").agg(F.collect_set(F.struct("start", "size")).alias("at"))  # windows of one text
        texts = rows.join(near, "digest").dropDuplicates(["digest", "doc_id"]).select("doc_id", "digest", "text", "at")
        words = texts.mapInArrow(_candidates, "doc_id bigint, digest bigint, n_words int, start int, size int, gram string")
        found = words.join(table.drop("h"), ["size", "gram"]).groupBy("doc_id", "digest").applyInPandas(_merge, _HITS)
    return found.dropDuplicates(["doc_id", "digest"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, drop_share: float = DROP_SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without their contaminated spans, columns as they came.

    A document of which at least ``drop_share`` of the words are contaminated goes as a whole;
    from others the spans are cut (between the first and the last character of their words).
    ``n_chars``, where there is one, follows the text. Null texts and clean documents stay as
    they are; repeated rows stay repeated.
    """
    new, items = unused(docs, "cleaned"), narrow(benchmark, "item_id", "text").where("text is not null")
    grams = _broadcast(items, n, broadcast_bytes)
    if grams is not None:
        out = docs.withColumn(new, _cleaned(grams, drop_share)(F.col("text"))).where(~F.col(new)["gone"]).withColumn("text", F.coalesce(F.col(new)["text"], F.col("text")))
    else:
        sha, id_, text_, share_ = (unused(docs, x) for x in ("digest", "hit_id", "cut_text", "hit_share"))
        hits = contamination(docs, benchmark, n, broadcast_bytes).withColumn(share_, F.col("hit_words") / F.col("n_words"))
        hits = hits.select(F.col("doc_id").alias(id_), F.col("digest").alias(sha + "_b"), share_, F.col("spans").alias(text_))
        same = (F.col("doc_id") == F.col(id_)) | (F.col("doc_id").isNull() & F.col(id_).isNull())
        joined = docs.withColumn(sha, digest()).join(hits, (F.col(sha) == F.col(sha + "_b")) & same, "left")
        out = joined.where(F.col(share_).isNull() | (F.col(share_) < F.lit(float(drop_share))))
        out = out.withColumn("text", F.when(F.col(text_).isNull(), F.col("text")).otherwise(_cut_text(F.col("text"), F.col(text_))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{x}`") for x in docs.columns])


def _cut_text(text: Column, spans: Column) -> Column:
    @F.pandas_udf("string")
    def cut_all(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut(t, [(x["a"], x["b"]) for x in s]) for t, s in zip(texts, found)], dtype=object)

    return cut_all(text, spans)
