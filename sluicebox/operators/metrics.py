"""Classifier metrics, features and training conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.operators.order import running_before

LENGTH = 200


def confusion(rows: DataFrame, keys: list[str], truth: str = "truth", guess: str = "guess") -> DataFrame:
    hit = lambda t, g: F.count_if((F.col(truth) == t) & (F.col(guess) == g))
    return rows.groupBy(*keys).agg(hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def metrics(counts: DataFrame, keys: list[str]) -> DataFrame:
    """accuracy, precision, recall, f1, macro_f1 (over labels in truth or guesses) and support. A zero divisor gives 0."""
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    has1, has0 = (tp + fp + fn > 0).cast("int"), (tn + fp + fn > 0).cast("int")
    return counts.select(
        *keys, _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        f1.alias("f1"), _ratio(f1 * has1 + f0 * has0, has1 + has0).alias("macro_f1"), (tp + tn + fp + fn).alias("support"),
    )


def conditions(rows: DataFrame) -> DataFrame:
    """``condition`` and ``role`` for rows with dataset (real or synthetic) and split: A trains on real rows, B on synthetic
    ones, C on both; A and C are validated on real rows, all are tested on real ones."""
    real, made = F.col("dataset") == "real", F.col("dataset") == "synthetic"
    train, check, test = (F.col("split") == s for s in ("train", "validation", "test"))
    pick = lambda name, role, cond: F.when(cond, F.struct(F.lit(name).alias("condition"), F.lit(role).alias("role")))
    uses = F.array(
        pick("A", "train", real & train), pick("B", "train", made & train), pick("C", "train", (real | made) & train),
        pick("A", "validation", real & check), pick("B", "validation", made & check), pick("C", "validation", real & check),
        *[pick(c, "test", real & test) for c in "ABC"],
    )
    return rows.select("*", F.inline(F.filter(uses, lambda x: x.isNotNull())))


def vocabulary(rows: DataFrame, tokens: str, least: int) -> DataFrame:
    """``token, index, n`` of tokens that occur at least ``least`` times, most frequent first, ties in the order of tokens."""
    counts = rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return running_before(counts, [-F.col("n"), F.col("token")], F.lit(1), "index").select("token", F.col("index").cast("int"), "n")


#: Tokens of a vocabulary up to which it is broadcast.
BROADCAST_ROWS = 2_000_000


def small(vocabulary: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The vocabulary, marked for a broadcast if it has at most ``limit`` rows: a hot token then moves no row; else the join's own skew handling has to do."""
    return F.broadcast(vocabulary) if vocabulary.limit(limit + 1).count() <= limit else vocabulary


def token_ids(rows: DataFrame, key: str, tokens: str, vocabulary: DataFrame, length: int = LENGTH) -> DataFrame:
    """``key, ids``: index + 1 of each of the first tokens, 0 for unknown ones and for padding. ``key`` must be unique."""
    each = rows.select(key, F.posexplode(F.slice(tokens, 1, length)).alias("pos", "token"))
    found = each.join(small(vocabulary.select("token", "index")), "token", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.col("index") + 1, F.lit(0)).alias("i")))).alias("o"))
    ids = F.coalesce(F.transform("o", lambda x: x["i"]), F.array().cast("array<int>"))
    return rows.select(key).join(found, key, "left").select(key, F.concat(ids, F.array_repeat(F.lit(0), length - F.size(ids))).alias("ids"))


def pooled_vectors(each: DataFrame, key: str, vectors: DataFrame, width: int) -> DataFrame:
    """``key, vector``: the mean vector over the key's known tokens, each as often as it occurs; keys without any have no row.

    ``each`` is a row per token, ``key, token``; a key's tokens are never gathered. A key has one
    partial row of sums per task, not one per dimension. Decimal sums don't depend on the order.
    """
    exact = vectors.select("token", F.transform("vector", lambda x: x.cast("double").cast("decimal(20,10)")).alias("vector"))
    counts = each.groupBy(key, "token").agg(F.count("*").cast("decimal(18,0)").alias("_times")).join(small(exact), "token")
    term = lambda i: F.sum(F.get("vector", F.lit(i)) * F.col("_times"))
    sums = counts.groupBy(key).agg(F.sum("_times").alias("_n"), *[term(i).alias(f"_{i}") for i in range(width)])
    return sums.select(key, F.array(*[F.col(f"_{i}").cast("double") / F.col("_n") for i in range(width)]).alias("vector"))


def mean_pool(each: DataFrame, key: str, vectors: DataFrame, width: int) -> DataFrame:
    """:func:`pooled_vectors` of every key, zeros where no token is known, as ``key, dim, value``."""
    pooled = each.select(key).distinct().join(pooled_vectors(each, key, vectors, width), key, "left")
    return pooled.select(key, F.posexplode(F.coalesce("vector", F.array(*[F.lit(0.0)] * width))).alias("dim", "value"))


def threshold(p: Column) -> Column:
    return (p >= F.lit(0.5)).cast("int")
