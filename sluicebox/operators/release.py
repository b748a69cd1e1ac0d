"""A release for experiments: selected commits, their splits, capped windows, audit pairs and a summary; slices, guards and conditions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.registry import MODES, dimension
from sluicebox.functions.text import let, token_windows, tokens, window_labels, window_starts, window_texts
from sluicebox.operators.selection import SEED, audit_pairs, balanced_select, commit_cap, commit_split

CONTEXT = ["application_type", "flow_pattern", "difficulty", "structure"]


@dataclass
class Release:
    synthetic: DataFrame
    real: DataFrame
    splits: DataFrame
    windows: DataFrame
    audit: DataFrame
    window_count: DataFrame


def windows_of(files: DataFrame, positive: int = 4, negative: int = 4, seed: int = SEED, window: int = 200, stride: int = 5) -> DataFrame:
    """The capped windows of each file, chosen within its row: ``dataset, mode, group_id, filename, start, label, tokens, n_windows``.

    Windows of a label are ranked by a hash of seed, group, file, label and tokens; ties by start.
    """
    key = lambda y, x: F.sha2(F.concat(F.lit(f"{seed}|"), F.col("group_id"), F.lit("|"), F.col("filename"), F.lit("|"), y.cast("string"), F.lit("|"), x), 256)

    def chosen(t: Column) -> Column:
        """Ranks are sorted without the tokens, of which only the chosen windows' are cut."""
        starts = window_starts(F.size(t), window, stride)
        labels = window_labels(F.col("source"), F.col("badparts"), window, stride, starts)
        ranks = F.zip_with(labels, window_texts(t, window, stride), lambda y, x: F.struct(key(y, x).alias("rank"), y.alias("label")))
        each = F.zip_with(ranks, starts, lambda r, s: F.struct(r["rank"].alias("rank"), s.alias("start"), r["label"].alias("label")))
        first = lambda r, y, n: F.slice(F.array_sort(F.filter(r, lambda x: x["label"] == y)), 1, n)
        cut = lambda x: F.struct(x["start"].alias("start"), x["label"].alias("label"), F.slice(t, x["start"] + 1, window).alias("tokens"))
        return let(each, lambda r: F.struct(F.size(r).alias("n"), F.transform(F.concat(first(r, 1, positive), first(r, 0, negative)), cut).alias("best")))

    ranked = files.select("dataset", "mode", "group_id", "filename", let(tokens(F.col("source")), chosen).alias("_w"))
    return ranked.select("dataset", "mode", "group_id", "filename", F.col("_w.n").alias("n_windows"), F.inline("_w.best"))


def first_of_groups(files: DataFrame, order: list[str]) -> DataFrame:
    """``group_id, dataset, mode`` of each group's first file in the order."""
    return files.groupBy("group_id").agg(F.min_by(F.struct("dataset", "mode"), F.struct(*order)).alias("f")).select("group_id", "f.dataset", "f.mode")


def prepare(synthetic: DataFrame, real: DataFrame, per_mode: int, seed: int = SEED, positive: int = 4, negative: int = 4) -> Release:
    """A release of ``per_mode`` synthetic commits a mode, chosen evenly over their contexts (fewer are an error), and up to as many real ones with all their files.

    Both are frames as the loaders give them. All windows of a group share its split.
    """
    flat = synthetic.select("*", *[F.col("context")[f].alias(f) for f in CONTEXT])
    short = dimension(synthetic.sparkSession).select("mode").join(flat.groupBy("mode").agg(F.count("*").alias("n")), "mode", "left").where(F.coalesce("n", F.lit(0)) < per_mode)
    lacking = sorted(r["mode"] for r in short.collect())  # seven modes
    if lacking:
        raise ValueError(f"fewer than {per_mode} records: {', '.join(lacking)}")
    chosen = balanced_select(flat.select("mode", "group_id", *CONTEXT), "mode", CONTEXT, "group_id", per_mode, seed)
    picked = synthetic.join(chosen, ["mode", "group_id"], "left_semi")
    capped = commit_cap(real, "mode", "group_id", per_mode, seed)
    columns = [c for c in capped.columns if c in picked.columns]
    every = picked.select(*columns).unionByName(capped.select(*columns))
    splits = commit_split(every, ["dataset", "mode"], "group_id", seed)
    cut = windows_of(every, positive, negative, seed).join(splits.select("group_id", "split"), "group_id")
    audit = audit_pairs(flat.join(chosen, ["mode", "group_id"], "left_semi"), "mode", CONTEXT, "group_id", 5, seed)
    counts = every.select(F.size(token_windows(F.col("source"), window_labels(F.col("source"), F.col("badparts")))).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return Release(picked, capped, splits, cut, audit, counts)


def release_summary(files: DataFrame, windows: DataFrame) -> DataFrame:
    """``section, key, value``: distinct groups of each dataset and mode (0 where there are none), file rows, windows by dataset and split, and by label."""
    grid = files.sparkSession.createDataFrame([(d, m) for d in ("synthetic", "real") for m in MODES], "dataset string, mode string")
    per = files.groupBy("dataset", "mode").agg(F.count_distinct("group_id").alias("groups"), F.count("*").alias("files"))
    both = grid.join(per, ["dataset", "mode"], "left")
    groups = both.select(F.concat("dataset", F.lit("_commits")).alias("section"), F.col("mode").alias("key"), F.coalesce("groups", F.lit(0)).alias("value"))
    rows = both.where("files is not null").select(F.concat("dataset", F.lit("_file_records")).alias("section"), F.col("mode").alias("key"), F.col("files").alias("value"))
    cells = windows.groupBy("dataset", "split", "label").agg(F.count("*").alias("n"))
    split = cells.groupBy(F.lit("windows").alias("section"), F.concat_ws(":", "dataset", "split").alias("key")).agg(F.sum("n").alias("value"))
    label = cells.groupBy(F.lit("labels").alias("section"), F.when(F.col("label") == 1, "positive_windows").otherwise("negative_windows").alias("key")).agg(F.sum("n").alias("value"))
    return groups.unionByName(rows).unionByName(split).unionByName(label)


def slice_of(rows: DataFrame, dataset: str, mode: str, split: str) -> DataFrame:
    return rows.where((F.col("dataset") == dataset) & (F.col("mode") == mode) & (F.col("split") == split))


NEEDED = [("real", "train"), ("real", "validation"), ("real", "test"), ("synthetic", "train"), ("synthetic", "validation")]


def empty_slices(rows: DataFrame, modes: list[str] | None = None) -> DataFrame:
    """``mode, dataset, split`` of the slices that a mode's experiments need and the rows don't have."""
    grid = rows.sparkSession.createDataFrame([(m, d, s) for m in (MODES if modes is None else modes) for d, s in NEEDED], "mode string, dataset string, split string")
    return grid.join(rows.select("mode", "dataset", "split").distinct(), ["mode", "dataset", "split"], "left_anti")


def assert_slices(rows: DataFrame, modes: list[str] | None = None) -> None:
    found = empty_slices(rows, modes).orderBy("mode", "dataset", "split").collect()  # five a mode
    if found:
        raise ValueError("no rows: " + ", ".join(f"{r['mode']} {r['dataset']} {r['split']}" for r in found))
