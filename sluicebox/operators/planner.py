"""Coverage planning: which contexts to fill next so that all marginals stay level."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.registry import CLASSES, FIELDS, FLOWS_OF, MODES, compatible, tuples
from sluicebox.functions.safe import fold_profile
from sluicebox.operators.selection import sha

SEED = 1337


def matching_modes(mode: Column, cwe: Column, key: Column) -> Column:
    """The classes that a record belongs to by its mode, its CWE or its key, in any case: most often one, several where they disagree."""
    fits = lambda k, c: F.coalesce(F.lower(mode) == k, F.lit(False)) | F.coalesce(F.lower(cwe) == c.lower(), F.lit(False)) | F.coalesce(F.lower(key) == k, F.lit(False))
    return F.filter(F.array(*[F.when(fits(k, c), F.lit(k)) for k, c, *_ in CLASSES]), lambda x: x.isNotNull())


def records_of(log: DataFrame, profile: str = "compact") -> DataFrame:
    """A log's records as the plan counts them: ``mode, fields, sample_index``, a row for each class that a record of the profile belongs to."""
    c = F.col("context")
    first = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    rows = log.where(fold_profile(first(F.col("generation_profile"), c["generation_profile"]), "compact") == profile)
    return rows.select(F.explode(matching_modes(first(F.col("mode"), c["mode"]), first(F.col("cwe"), c["cwe"]), c["cwe_key"])).alias("mode"), *[c[f].alias(f) for f in FIELDS], c["sample_index"].alias("sample_index"))


def wanted_modes(filters: list[str] | None) -> list[str]:
    """The classes that filters name by key, mode or CWE; names of none are passed over. No filter names all, filters of which none fits name none."""
    names = {x.lower().strip() for x in filters or []}
    return [k for k, c, *_ in CLASSES if not filters or k in names or c.lower() in names]


def existing_counts(records: DataFrame, profile: str = "compact") -> DataFrame:
    """``mode, fields, n`` of each achievable context, with zero for those without records."""
    grid = tuples(records.sparkSession, profile)
    have = records.groupBy("mode", *FIELDS).agg(F.count("*").alias("n"))
    return grid.join(have, ["mode", *FIELDS], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def choose(counts: Counter, options: list[tuple], mode: str, slot: int, seed: int = SEED) -> tuple:
    """The context with the least count, then the least marginals, then the least flexible structure, then hash."""
    sums = [Counter() for _ in FIELDS]
    for t, n in counts.items():
        for i, v in enumerate(t):
            sums[i][v] += n
    return min(options, key=lambda t: (counts[t], *(sums[i][v] for i, v in enumerate(t)), len(FLOWS_OF[t[2]]), sha("|".join((str(seed), mode, str(slot), *t)))))


def plan(records: DataFrame, per_mode: int, modes: list[str] | None = None, profile: str = "compact", seed: int = SEED) -> DataFrame:
    """``mode, sample_index, fields, plan_order``: the slots that raise each mode to ``per_mode`` records.

    ``records`` has mode, fields and sample_index. The counts are aggregated by the engine; the
    choice itself runs over at most 90 contexts a mode on the driver, a slot at a time. Names that
    are no mode are passed over, unless none is left: then nothing is planned.
    """
    if per_mode < 0:
        raise ValueError("a negative target")
    spark: SparkSession = records.sparkSession
    wanted = [m for m in MODES if modes is None or m in modes]
    grid = {(r["mode"], *(r[f] for f in FIELDS)): r["n"] for r in existing_counts(records, profile).collect()}
    last = {r[0]: (r[1], r[2]) for r in records.groupBy("mode").agg(F.count("*"), F.max("sample_index")).collect() if r[0] in MODES}
    out = []
    for m in wanted:
        have, top = last.get(m, (0, None))
        counts = Counter({k[1:]: n for k, n in grid.items() if k[0] == m})
        options = compatible(m, profile)
        index = 0 if top is None else top + 1
        for slot in range(max(0, per_mode - have)):
            t = choose(counts, options, m, slot, seed)
            counts[t] += 1
            out.append((m, index + slot, *t, sha("|".join((str(seed), m, str(index + slot), *t)))))
    out.sort(key=lambda r: r[-1])
    schema = "mode string, sample_index int, " + ", ".join(f"{f} string" for f in FIELDS) + ", plan_order string"
    return spark.createDataFrame(out, schema)


def next_sample_id(ids: Column, prefix: Column) -> Column:
    """An aggregate: the prefix, and one more than the highest number that stands behind it alone; other ids don't count."""
    rest = F.when(ids.startswith(prefix), F.substring(ids, F.length(prefix) + 1, F.length(ids)))
    n = F.max(F.when(rest.rlike(r"\A[0-9]+\z"), rest.try_cast("decimal(38,0)")))
    return F.concat(F.max(prefix), _six(F.coalesce(n, F.lit(0).cast("decimal(38,0)")) + 1))


def _six(n: Column) -> Column:
    """At least six digits."""
    s = n.cast("decimal(38,0)").cast("string")
    return F.when(F.length(s) < 6, F.lpad(s, 6, "0")).otherwise(s)


def round_robin(mode: str, index: int, profile: str = "compact") -> tuple:
    options = compatible(mode, profile)
    return options[index % len(options)]
