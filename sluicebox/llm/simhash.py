"""Near-duplicate groups by SimHash, searched with BK-trees.

Each document gets two 64-bit SimHash fingerprints: of its words (weight: root of the count) and
of its word pairs. Two documents are near copies if the word fingerprints differ in at most
``radius`` bits and the pair fingerprints in at most ``pair_radius``; groups are the connected
components.

A single BK-tree over all fingerprints can't prune at this radius (distances of unrelated texts
crowd around 30 bits), and broadcasting it would grow with the corpus. So the fingerprints are
sharded by the pigeonhole principle: the 64 bits are cut into blocks, and two fingerprints within
the radius are within a block's share of it in at least one block (see :func:`blocks`). Each
fingerprint goes to every shard in which such a partner can meet it, so no pair within the radius
is missed. A shard meets in one task by a shuffle and is one leaf, all compared with all in tiles.
All fingerprints are queries; a shard has no size limit. A shard with more near pairs than
``DENSE`` per fingerprint, or of more than ``FLAT`` fingerprints, is searched with its own
BK-tree: a group is grown from a pivot at a time, and what has joined a group isn't searched
again, so a hot shard of copies costs time in proportion to its size. Leaves are large, because
a tree of small ones visits nearly all of them at this radius.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import WORD, digest, dropped, narrow, text_slices, unused, written

RADIUS = 10
PAIR_RADIUS = 17
#: A text of fewer words has no near copies but those with the same words in a row: another word is a quarter of it or more.
MIN_WORDS = 5
#: Fingerprints of a leaf of the tree: so many that the comparisons take the time, not the calls.
LEAF = 1 << 16
#: Fingerprints of a shard that are compared all with all, near pairs for each of them up to which the pairs are the edges, and comparisons made at once.
FLAT, DENSE, AT_ONCE = 1 << 20, 8, 1 << 17
#: Edges that a task holds before it contracts them.
EDGES = 1 << 19


def blocks(radius: int) -> list[tuple[list[int], int]]:
    """The bit positions of each block, and its share of the radius (0, 1 or 2 bits).

    The shares plus one each sum up to radius + 1: a pair that is beyond the share in every block
    differs in at least radius + 1 bits.
    """
    m = min(64, radius // 3 + 1)
    left = radius - m + 1
    return [(list(range(i, 64, m)), max(0, min(2, left - 2 * i))) for i in range(m)]


def shard_keys(radius: int) -> list[tuple[int, int]]:
    """For each shard of a fingerprint, the bits kept and the bits flipped: pairs within the radius agree in at least one.

    Within two bits: both flip at most one bit to the value between them. Within one: both leave it out.
    """
    keys = []
    for bits, share in blocks(radius):
        mask = sum(1 << b for b in bits)
        if share == 1:
            keys += [(mask ^ (1 << b), 0) for b in bits]
        else:
            keys += [(mask, 0)] + [(mask, 1 << b) for b in bits if share == 2]
    return keys


def _signs(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32) * 2 - 1


def _pack(sums: np.ndarray) -> int:
    return int(np.packbits(sums > 0, bitorder="little").view("<i8")[0])


def fingerprint(words: list[str]) -> tuple[int, int]:
    """SimHash of the words, and of the pairs of neighbouring words, as signed 64-bit numbers."""
    count = Counter(words)
    h = {w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in count}
    weights = np.sqrt(np.fromiter(count.values(), dtype=np.float32, count=len(count)))
    first = weights @ _signs(np.fromiter(h.values(), dtype=np.uint64, count=len(h)))
    seq = np.fromiter((h[w] for w in words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        pair = (seq[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (seq[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        pair ^= pair >> np.uint64(31)
        pair *= np.uint64(0x94D049BB133111EB)
        pair ^= pair >> np.uint64(33)
    total = np.zeros(64, dtype=np.float64)
    for a in range(0, len(pair), 65536):
        total += _signs(pair[a : a + 65536]).sum(axis=0, dtype=np.float64)
    return _pack(first), _pack(total)


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent; up to LEAF fingerprints stay a flat list.

    Fingerprints can be taken out, so that a search meets only those which no group holds yet.
    """

    __slots__ = ("f1", "root", "children", "leaf", "alive")

    def __init__(self, f1: np.ndarray, index: np.ndarray):
        self.f1, self.children, self.leaf = f1, {}, index
        self.root, self.alive = -1, len(index)
        if len(index) > LEAF:
            self.root, rest = int(index[0]), index[1:]
            self.leaf = index[:1]
            d = np.bitwise_count(f1[rest] ^ f1[self.root])
            for k in np.unique(d):
                self.children[int(k)] = BKTree(f1, rest[d == k]) if k else _flat(f1, rest[d == 0])

    def take(self, query: int, radius: int, keep) -> list[int]:  # noqa: ANN001
        """Takes out and returns the fingerprints within the radius for which keep(indices) holds."""
        out: list[int] = []
        if len(self.leaf):
            near = np.bitwise_count(self.f1[self.leaf] ^ self.f1[query]) <= radius
            near[near] = keep(self.leaf[near])
            if near.any():
                out = self.leaf[near].tolist()
                self.leaf = self.leaf[~near]
        if self.children:
            d = int((self.f1[self.root] ^ self.f1[query]).item().bit_count())
            for k, child in [(k, c) for k, c in self.children.items() if d - radius <= k <= d + radius]:
                found = child.take(query, radius, keep)
                if found:
                    out += found
                    if not child.alive:
                        del self.children[k]
        self.alive -= len(out)
        return out


def _flat(f1: np.ndarray, index: np.ndarray) -> BKTree:
    tree = BKTree(f1, index[:0])
    tree.leaf, tree.alive = index, len(index)
    return tree


def shard_groups(f1: np.ndarray, f2: np.ndarray, radius: int, pair_radius: int) -> np.ndarray:
    """For each fingerprint of a shard, the index of the first one of its group."""
    label = np.full(len(f1), -1, dtype=np.int64)
    tree = BKTree(f1, np.arange(len(f1)))
    for start in range(len(f1)):
        if label[start] >= 0:
            continue
        queue, label[start] = [start], start
        while queue and tree.alive:
            q = queue.pop()
            found = tree.take(q, radius, lambda x: np.bitwise_count(f2[x] ^ f2[q]) <= pair_radius)  # noqa: B023
            fresh = [x for x in found if label[x] < 0]
            label[fresh] = start
            queue += fresh
    return label


def near_pairs(x1: np.ndarray, x2: np.ndarray, radius: int, pair_radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(shard, i, j) with i < j of the near pairs in shards of one size (a row each); None if one shard alone has too many."""
    k, size = x1.shape
    step, found, n = max(1, AT_ONCE // (k * size)), [], 0
    for r in range(0, size, step):
        near = np.bitwise_count(x1[:, r : r + step, None] ^ x1[:, None, r:]) <= radius
        s, i, j = np.unravel_index(np.flatnonzero(near), near.shape)  # few are near; nonzero in three dimensions takes longer than the comparison
        ahead = i < j
        s, i, j = s[ahead], i[ahead] + r, j[ahead] + r
        near = np.bitwise_count(x2[s, i] ^ x2[s, j]) <= pair_radius
        found.append((s[near], i[near], j[near]))
        n += int(near.sum())
        if k == 1 and n > DENSE * size:
            return None
    return tuple(np.concatenate([f[c] for f in found]) for c in range(3))


def forest(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges with the same components: each fingerprint ``b1, b2`` but the least of its component, with that one as ``a1, a2``."""
    x1, x2 = np.concatenate([a1, b1]), np.concatenate([a2, b2])
    order = np.lexsort((x2, x1))
    x1, x2 = x1[order], x2[order]
    first = np.r_[True, (x1[1:] != x1[:-1]) | (x2[1:] != x2[:-1])]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(first) - 1
    x1, x2 = x1[first], x2[first]
    head, u, v = np.arange(len(x1)), number[: len(a1)], number[len(a1) :]
    while len(u):
        u, v = head[u], head[v]
        apart = u != v
        u, v = u[apart], v[apart]
        np.minimum.at(head, np.maximum(u, v), np.minimum(u, v))
        while (head[head] != head).any():
            head = head[head]
    moved = np.flatnonzero(head != np.arange(len(head)))
    return x1[head[moved]], x2[head[moved]], x1[moved], x2[moved]


def _search(radius: int, pair_radius: int):  # noqa: ANN202
    schema = pa.schema([("a1", pa.int64()), ("a2", pa.int64()), ("b1", pa.int64()), ("b2", pa.int64())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Whole shards, some at a time: arrays of shard number, f1 and f2."""
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(x).to_numpy() for x in ("shard", "f1", "f2")))
            last = held[-1][0]
            cut = len(last) - int((last[::-1] != last[-1]).argmax()) if last[0] != last[-1] else 0
            if cut:
                yield tuple(np.concatenate([*(h[i] for h in held[:-1]), held[-1][i][:cut]]) for i in range(3))
                held = [tuple(x[cut:] for x in held[-1])]
        if held:
            yield tuple(np.concatenate([h[i] for h in held]) for i in range(3))

    def out(edges: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(edges[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in edges], schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[np.ndarray, ...]] = []
        for shard, f1, f2 in shards(batches):
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            sizes = np.diff(np.r_[starts, len(shard)])
            u1, u2 = f1.view(np.uint64), f2.view(np.uint64)
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for size in np.unique(sizes[sizes > 1]):
                own = starts[sizes == size]
                some = max(1, AT_ONCE // (size * size))
                for part in (own[x : x + some] for x in range(0, len(own), some)):
                    at = part[:, None] + np.arange(size)
                    found = near_pairs(u1[at], u2[at], radius, pair_radius) if size <= FLAT else None
                    if found is not None:
                        a.append(part[found[0]] + found[1])
                        b.append(part[found[0]] + found[2])
                        continue
                    for s in part:
                        label = shard_groups(u1[s : s + size], u2[s : s + size], radius, pair_radius)
                        moved = np.flatnonzero(label != np.arange(size))
                        a.append(s + label[moved])
                        b.append(s + moved)
            if a and sum(map(len, a)):
                x, y = np.concatenate(a), np.concatenate(b)
                edges.append((f1[x], f2[x], f1[y], f2[y]))
                if sum(len(e[0]) for e in edges) > EDGES:
                    edges = [forest(*map(np.concatenate, zip(*edges)))]
                    if len(edges[0][0]) > EDGES // 2:
                        yield from out(edges.pop())
        if edges:
            yield from out(forest(*map(np.concatenate, zip(*edges))))

    return search


def near_edges(prints: DataFrame, radius: int = RADIUS, pair_radius: int = PAIR_RADIUS) -> DataFrame:
    """Edges between distinct fingerprints ``a1, a2, b1, b2`` whose components are the groups; those of a task are a forest."""
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("bigint")
    keys = [F.xxhash64(signed(mask), F.col("f1").bitwiseAND(signed(mask)).bitwiseXOR(signed(flip))) for mask, flip in shard_keys(radius)]
    exploded = prints.select("f1", "f2", F.explode(F.array(*keys)).alias("shard"))
    shards = exploded.repartition("shard").sortWithinPartitions("shard", "f1", "f2")
    return shards.mapInArrow(_search(radius, pair_radius), "a1 bigint, a2 bigint, b1 bigint, b2 bigint")


def components(edges: DataFrame) -> DataFrame:
    """``u, v``: each node of the edges ``u, v`` (strings) and the smallest node of its component.

    Rounds of large-star and small-star (Kiveris et al. 2014) run until no edge changes, each
    round's edges in a table in the shared folder.
    """
    now = written(edges.distinct(), "forest")
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.collect_set("v").alias("vs"))
        large = least.select(F.explode("vs").alias("v"), "m", "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = down.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("vs"))
        star = small.select(F.explode(F.concat(F.array("u"), "vs")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, now = now, written(star, "star")
        dropped(last)
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(seen) == state:
            return now
        state = tuple(seen)


def near_groups(docs: DataFrame, radius: int = RADIUS, pair_radius: int = PAIR_RADIUS) -> DataFrame:
    """One row per document in a group of two or more: ``doc_id, digest, keeper_id, keeper_digest``.

    The keeper is the group's first document in the order of doc_id (null first) and digest; its
    own row is in the result. Equal texts are in one group; texts of fewer than MIN_WORDS words
    group with those of the same words in the same order (case and signs aside); a text without
    words groups with nothing, nor does a null text. Rows equal in doc_id and text are one
    document. Extra columns are ignored.
    """
    rows = narrow(docs, "doc_id", "text").where("text is not null").withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("digest", digest())
    long = rows.mapInArrow(_with_same, "doc_id bigint, digest bigint, f1 bigint, f2 bigint, same string")
    marked = written(long.distinct(), "prints")
    full = marked.where("f1 is not null")
    prints = full.select("f1", "f2").distinct()
    name = lambda a, b: F.concat_ws(":", F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))
    edges = near_edges(prints, radius, pair_radius).select(name("a1", "a2").alias("u"), name("b1", "b2").alias("v"))
    group = components(edges)
    node = marked.withColumn("node", F.when(F.col("f1").isNotNull(), name("f1", "f2")).otherwise(F.col("same")))
    joined = node.join(group.select(F.col("u").alias("node"), F.col("v").alias("head")), "node", "left").withColumn("group", F.coalesce("head", "node"))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "digest")
    first = joined.groupBy("group").agg(F.min(key).alias("keeper"), F.count("*").alias("n")).where("n > 1")
    out = joined.join(first, "group")
    return out.select("doc_id", "digest", F.col("keeper.doc_id").alias("keeper_id"), F.col("keeper.digest").alias("keeper_digest"))


def _with_same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        f1, f2, same, at = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            words = WORD.findall(text.lower())
            if not words:
                continue
            a, b = fingerprint(words) if len(words) >= MIN_WORDS else (None, None)
            f1.append(a)
            f2.append(b)
            same.append(hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest() if a is None else None)
            at.append(i)
        own = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("digest"), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(same, pa.string())], names=["doc_id", "digest", "f1", "f2", "same"])


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """The documents without near copies: of each group the keeper stays, columns as they came.

    Rows equal in doc_id and text all stay or all go, but for exact copies of a keeper's row,
    which are left to the caller. Null texts and texts without words stay.
    """
    id_, sha_ = unused(docs, "gone_id"), unused(docs, "gone_digest")
    gone = near_groups(docs, **options).where("not (doc_id <=> keeper_id and digest = keeper_digest)").select(F.col("doc_id").alias(id_), F.col("digest").alias(sha_))
    same = (F.col("doc_id") == F.col(id_)) | (F.col("doc_id").isNull() & F.col(id_).isNull())
    return docs.join(gone, (digest() == F.col(sha_)) & same, "left_anti")
