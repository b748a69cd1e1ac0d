"""Selection by hash rank: caps, splits, audits, balanced choice. Nothing depends on partitioning or arrival."""

from __future__ import annotations

import hashlib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20260624


def stable_rank(group: Column, seed: int = SEED) -> Column:
    """Hex SHA-256 of seed and group: a random but reproducible order."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), group), 256)


def group_id(dataset: Column, mode: Column, repo: Column, commit: Column) -> Column:
    return F.concat_ws(":", dataset, mode, repo, commit)


def commit_cap(files: DataFrame, mode: str, group: str, cap: int, seed: int = SEED) -> DataFrame:
    """All files of the first ``cap`` groups of each mode by rank."""
    groups = files.select(mode, group).distinct()
    ranked = groups.withColumn("_n", F.row_number().over(Window.partitionBy(mode).orderBy(stable_rank(F.col(group).cast("string"), seed), group)))
    return files.join(ranked.where(F.col("_n") <= cap).drop("_n"), [mode, group], "left_semi")


def split_of(position: Column, n: Column) -> Column:
    """Split by 1-based rank in a set of n. Double arithmetic on purpose: 0.7 of 90 is 62.99..., so 62."""
    train = F.greatest(F.lit(1), (n * F.lit(0.70)).cast("int"))
    until = F.when(n >= 3, F.least(F.greatest(train + 1, (n * F.lit(0.85)).cast("int")), n - 1)).otherwise(train)
    return F.when(position <= train, "train").when(position <= until, "validation").otherwise("test")


def commit_split(files: DataFrame, keys: list[str], group: str, seed: int = SEED) -> DataFrame:
    """``keys, group, split``: a row per group; all files of a group share its split."""
    groups = files.select(*keys, group).distinct()
    by = Window.partitionBy(*keys)
    at = F.row_number().over(by.orderBy(stable_rank(F.col(group).cast("string"), seed), group))
    return groups.withColumn("_at", at).withColumn("_n", F.count("*").over(by)).select(*keys, group, split_of(F.col("_at"), F.col("_n")).alias("split"))


def cap_windows(windows: DataFrame, file: list[str], label: str, rank: Column, order: str, positive: int = 4, negative: int = 4) -> DataFrame:
    """The first windows of each file and label by rank; equal ranks in window order."""
    n = F.row_number().over(Window.partitionBy(*file, label).orderBy(rank, order))
    return windows.withColumn("_n", n).where(F.col("_n") <= F.when(F.col(label) == 1, positive).otherwise(negative)).drop("_n")


def audit_pairs(rows: DataFrame, mode: str, context: list[str], group: str, count: int = 5, seed: int = SEED) -> DataFrame:
    """Per mode the first row, by rank, of each distinct context, up to ``count``; a pool no larger is taken whole."""
    r = stable_rank(F.col(group).cast("string"), seed)
    ranked = rows.withColumn("_r", r).withColumn("_pool", F.count("*").over(Window.partitionBy(mode)))
    ranked = ranked.withColumn("_first", F.row_number().over(Window.partitionBy(mode, *context).orderBy("_r", group)))
    kept = ranked.where((F.col("_pool") <= count) | (F.col("_first") == 1))
    n = F.row_number().over(Window.partitionBy(mode).orderBy("_r", group))
    return kept.withColumn("audit_rank", n).where((F.col("_pool") <= count) | (F.col("audit_rank") <= count)).drop("_r", "_pool", "_first")


def balanced_rounds(rows: DataFrame, mode: str, context: list[str], group: str, seed: int = SEED) -> DataFrame:
    """``round``: a row's place, by rank, in its full context. The greedy choice takes all of round r before any of r + 1."""
    w = Window.partitionBy(mode, *context).orderBy(stable_rank(F.col(group).cast("string"), seed), group)
    return rows.withColumn("round", F.row_number().over(w))


def balanced_select(rows: DataFrame, mode: str, context: list[str], group: str, per_mode: int, seed: int = SEED) -> DataFrame:
    """``mode, group, pick``: the greedy choice of ``per_mode`` rows a mode with the least full-context count, then the
    least counts of the context's fields in order, then rank.

    Whole rounds are settled by ``round`` alone; a fold runs only over the round that crosses the
    quota, with the field counts of the rounds before. A mode with fewer rows gives all of them.
    """
    placed = balanced_rounds(rows, mode, context, group, seed).withColumn("_r", stable_rank(F.col(group).cast("string"), seed))
    sizes = placed.groupBy(mode, "round").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(mode).orderBy("round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).where(F.col("_before") < per_mode).withColumn("_whole", F.col("_before") + F.col("_size") <= per_mode)
    live = placed.join(sizes.drop("_size"), [mode, "round"])
    whole = live.where("_whole").select(mode, F.col(group).cast("string").alias(group))
    edge_counts = F.struct(*context)
    done = live.where("_whole").groupBy(mode, *context).agg(F.count("*").alias("n")).groupBy(mode).agg(F.collect_list(F.struct(edge_counts.alias("c"), "n")).alias("_done"))
    edge = live.where("not _whole").join(done, mode, "left").select(mode, F.col(group).cast("string").alias(group), "_r", *context, (F.lit(per_mode) - F.col("_before")).cast("int").alias("_want"), F.to_json("_done").alias("_done"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        counts = [Counter() for _ in context]
        for x in json.loads(pdf["_done"].iloc[0] or "[]"):
            for i, f in enumerate(context):
                counts[i][x["c"].get(f)] += x["n"]
        left = [tuple(r) for r in pdf[[group, "_r", *context]].astype(object).where(pdf[[group, "_r", *context]].notna(), None).itertuples(index=False)]
        taken = []
        for _ in range(int(pdf["_want"].iloc[0])):
            best = min(left, key=lambda r: (*(counts[i][r[2 + i]] for i in range(len(context))), r[1], r[0]))
            left.remove(best)
            taken.append(best[0])
            for i in range(len(context)):
                counts[i][best[2 + i]] += 1
        return pd.DataFrame({mode: pdf[mode].iloc[0], group: taken})

    # A group of the fold holds one round of one mode: at most a row for each distinct context.
    partial = edge.groupBy(mode).applyInPandas(fold, f"{mode} string, {group} string")
    return whole.unionByName(partial)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
