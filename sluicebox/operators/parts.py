"""Which texts hold which parts verbatim."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of parts up to which their automaton is broadcast.
BROADCAST_BYTES = 32 << 20
#: White-space words of a part, its second on, that a text must have in a row before the part is looked for (the way without a broadcast).
KEY_WORDS = 4


def with_parts(docs: DataFrame, parts: DataFrame, key: str = "doc_id", part_key: str = "item_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with ``parts array<string>``: the parts that the text holds, in the order of their key; empty where it holds none.

    While the parts are small (their size is checked), an automaton over all of them is broadcast
    and each text is read once: no row moves. Beyond that, see :func:`_joined`. Null and empty
    parts are in nothing.
    """
    own = parts.select(F.col(part_key).alias("part_key"), F.col("text").alias("part")).where("part <> ''")
    if own.agg(F.coalesce(F.sum(F.octet_length("part")), F.lit(0))).first()[0] > broadcast_bytes:
        found = _joined(docs, own, key)
        return docs.join(found, key, "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))
    rows = own.orderBy("part_key", "part").toLocalIterator()
    sent = docs.sparkSession.sparkContext.broadcast([r["part"] for r in rows])

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        listed = sent.value
        search = _automaton(listed)
        for texts in batches:
            yield pd.Series([[listed[i] for i in sorted(search(t))] if t else [] for t in texts], dtype=object)

    return docs.withColumn("parts", find(F.col("text")))


def _automaton(listed: list[str]):  # noqa: ANN202
    import ahocorasick

    at: dict[str, list[int]] = {}
    for i, part in enumerate(listed):
        at.setdefault(part, []).append(i)
    tree = ahocorasick.Automaton()
    for part, places in at.items():
        tree.add_word(part, places)
    if not at:
        return lambda text: set()
    tree.make_automaton()
    return lambda text: {i for _, places in tree.iter(text) for i in places}


def parts_within(docs: DataFrame, parts: DataFrame, key: str = "doc_id", part_key: str = "item_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``key, text, parts``: only the texts that hold a part."""
    return with_parts(docs.select(key, "text"), parts, key, part_key, broadcast_bytes).where(F.size("parts") > 0)


def _joined(docs: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """``key, parts`` by joins. A part's inner words stand in the text as they are, so runs of words find the candidates by an
    equi-join, and the part itself is then compared. Parts of fewer words than a run needs are compared with every text."""
    words = lambda c: F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+", -1), lambda w: w != "")
    own = own.withColumn("w", words(F.col("part"))).withColumn("row", F.monotonically_increasing_id())
    long = own.where(F.size("w") >= KEY_WORDS + 2).select("row", "part_key", "part", F.xxhash64(F.array_join(F.slice("w", 2, KEY_WORDS), " ")).alias("run"))
    runs = docs.where("text is not null").select(key, words(F.col("text")).alias("w")).where(F.size("w") >= KEY_WORDS + 2)
    each = runs.select(key, F.explode(F.expr(f"transform(sequence(1, size(w) - {KEY_WORDS}), i -> xxhash64(array_join(slice(w, i + 1, {KEY_WORDS}), ' ')))")).alias("run"))
    hits = each.join(long, "run").select(key, "row", "part_key", "part").distinct()
    found = docs.select(key, "text").join(hits, key).where(F.contains("text", F.col("part")))
    short = own.where(F.size("w") < KEY_WORDS + 2).select("row", "part_key", "part")
    rest = docs.select(key, "text").join(short, F.contains("text", F.col("part")))
    both = found.select(key, "row", "part_key", "part").unionByName(rest.select(key, "row", "part_key", "part"))
    return both.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part_key", "part", "row"))).alias("p")).select(key, F.col("p.part").alias("parts"))
