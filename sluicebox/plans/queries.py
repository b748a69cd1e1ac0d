"""The registered queries of the curation operators over the given tables.

``documents`` stand for records (doc_id is both id and order), ``benchmark`` texts that a document
holds for its parts, ``conversations`` for commits with a file per turn, ``labels`` for review and truth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions import prompts, pycode, rules, safe, scan, text
from sluicebox.functions.registry import APPS, LEVELS, MODES, dimension, tuples
from sluicebox.operators import candidates, coverage, dedup, export, metrics, models, planner, policy, release, reports, revalidation, selection, validation, verify
from sluicebox.operators.parts import parts_within
from sluicebox.operators.parts import with_parts as parts_column
from sluicebox.operators.schemas import BALANCE
from sluicebox.sources.files import RECORD, corpus_chunks, load_records
from sluicebox.sources.shared import spread

FIELDS = ["lang", "quality", "toxic"]
CAP, PER_MODE, AUDIT = 15, 20, 5
VOCABULARY_MIN = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def joined(c: Column) -> Column:
    """An array of strings as one value; a line end between the items."""
    return F.array_join(c, "\n")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels as text; unknown where there is none."""
    marks = table(spark, sf_dir, "labels").select("doc_id", *[F.col(x).cast("string").alias(x) for x in ("quality", "toxic")])
    rows = table(spark, sf_dir, "documents").join(marks, "doc_id", "left")
    return rows.withColumns({x: safe.truthy(F.col(x), "unknown") for x in ("quality", "toxic")})


def with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, parts`` of the documents that hold a benchmark text."""
    return parts_within(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_column(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as files of commits: ``mode, group_id`` beside the columns."""
    modes = F.array(*[F.lit(m) for m in MODES])
    rows = table(spark, sf_dir, "conversations").withColumn("mode", F.get(modes, (F.col("conv_id") % len(MODES)).cast("int")))
    return rows.withColumn("group_id", selection.group_id(F.lit("real"), F.col("mode"), F.lit("repo"), F.col("conv_id").cast("string")))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, before, after``: the text of each turn and of the next one."""
    a = table(spark, sf_dir, "conversations")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return a.select("conv_id", "turn", F.col("text").alias("before")).join(b, ["conv_id", "turn"])


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews made of labels and texts: required for labelled documents, skipped for some, absent for the rest; some contradict themselves."""
    good = F.col("quality") == 1
    n = F.col("n_chars")
    kinds = F.array(*map(F.lit, [*policy.REASON_CATEGORIES, "weak fix"]))
    review = F.struct(
        (F.col("toxic") == 0).alias("required"), F.when(n % 10 == 0, "error").when(n % 10 == 1, "not_run").otherwise("completed").alias("status"), F.when(n % 9 == 0, "unsure").when(n % 23 == 0, "maybe").when(good, "pass").otherwise("fail").alias("verdict"),
        good.alias("cwe_correct"), good.alias("fix_correct"), F.when(n % 31 > 0, n > 200).alias("context_correct"), F.lit(True).alias("runtime_plausible"),
        F.when(good & (n % 7 > 0), "none").otherwise(F.get(kinds, (n % 7).cast("int"))).alias("reason_category"), F.col("lang").alias("provider"), F.lit(None).cast("string").alias("model"),
    )
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.withColumn("review", F.when(F.col("quality").isNotNull(), review))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a log of records (RECORD): texts are the code, labels make the reviews, numbers of characters the states."""
    d, n = F.col("doc_id"), F.col("n_chars")
    pick = lambda xs, c: F.get(F.array(*[F.lit(x) for x in xs]), c.cast("int"))
    mode = F.when(d % 8 < 7, pick(MODES, d % 8))
    context = F.struct(
        F.when(d % 3 == 0, "sql").alias("cwe_key"), F.lit(None).cast("string").alias("cwe"), F.lit(None).cast("string").alias("cwe_name"), F.when(d % 16 == 7, F.col("lang")).alias("mode"), pick(APPS, d % 5).alias("application_type"), pick(["direct", "", "complex flow"], d % 3).alias("flow_pattern"),
        pick(LEVELS, n % 3).alias("difficulty"), pick(["class_based", "single_function"], n % 2).alias("structure"), F.when(d % 10 > 0, d.cast("int")).alias("sample_index"), F.when(d % 7 == 0, "window_balanced").alias("generation_profile"),
    )
    found = lambda *ids: F.array(*[F.struct(F.lit("B602").alias("test_id"), F.lit(i).alias("check_id"), F.lit("a.py").alias("filename"), F.lit(None).cast("string").alias("path")) for i in ids])
    run = lambda status, available, findings: F.struct(F.lit("t").alias("name"), available.alias("available"), status.alias("status"), F.lit(None).cast("array<string>").alias("command"), F.lit(0).alias("returncode"), findings.alias("findings"), F.lit(None).cast("string").alias("error"))
    states = F.when(d % 6 < 4, pick(["success", "missing", "timeout", "odd"], d % 6))
    left = F.when(d % 4 == 0, found("lib.rules.cwe-79.xss-helper")).when(d % 4 == 1, found("rules.cwe-89.sql-injection", "other.rule", "rules.cwe-89.sql-injection"))
    validated = F.struct(
        (n % 4 > 0).alias("passed"), F.split("text", "\n", -1).alias("reasons"), F.array_repeat(F.lit("w"), (n % 3).cast("int")).alias("warnings"),
        F.when(n % 9 > 0, F.struct((n % 5 > 0).alias("passed"), F.array().cast("array<string>").alias("reasons"), F.array(F.lit("a"), F.lit("https://x.example")).alias("vulnerable_markers"), F.lit(None).cast("array<string>").alias("fixed_markers"))).alias("structural"),
        F.when(d % 6 < 5, run(states, F.lit(True), found())).alias("bandit_before"), run(F.lit("success"), F.lit(True), found("x")).alias("bandit_after"),
        F.lit(None).cast(validation.TOOL_RUN).alias("semgrep_before"), run(F.lit(None).cast("string"), d % 2 == 0, F.coalesce(left, found())).alias("semgrep_after"),
        F.lit(None).cast(validation.OLD_RUNS).alias("tool_results"), F.lit(None).cast(BALANCE).alias("window_balance"),
    )
    rows = reviews(spark, sf_dir).select(
        d.alias("ord"), F.when(d % 50 == 1, "dup").when(d % 50 != 2, F.concat(F.lit("r"), d.cast("string"))).alias("id"), F.lit("CWE-").alias("cwe"), mode.alias("mode"), F.when(d % 13 > 0, context).alias("context"),
        F.when(d % 5 == 0, "window_balanced").alias("generation_profile"), F.col("source").alias("commit_message"), F.concat(F.lit("/srv/"), F.col("source"), F.lit(".py")).alias("filename"), F.col("text").alias("vulnerable_code"), F.upper("text").alias("fixed_code"),
        F.lit("-a\n+b").alias("diff"), F.when(d % 2 == 0, F.array(F.lit("p"))).alias("badparts"), F.array(F.lit("q")).alias("goodparts"), F.col("lang").alias("provider"),
        F.when(d % 11 > 0, validated).alias("validation"), "review", F.split("text", "\n", -1).alias("reject_reason"), F.when(F.col("toxic") == 1, F.struct(F.when(n % 2 == 0, "near_duplicate").otherwise("odd check").alias("check"), F.lit("r").alias("reason"))).alias("diversity_rejection"),
    )
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], RECORD).schema])


# --- tokens and windows -----------------------------------------------------------------------


def lex_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = text.let(text.tokens(F.col("text")), lambda t: F.struct(F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), sha(F.array_join(t, " ")).alias("tokens_sha")))
    return table(spark, sf_dir, "documents").select("doc_id", one.alias("x")).select("doc_id", "x.*")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("lang", F.size(text.tokens(F.col("text"))).alias("n"))
    return sizes.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.max("n").alias("longest"))


def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = text.window_starts(F.size(text.tokens(F.col("text"))))
    one = text.let(starts, lambda s: F.struct(F.size(s).alias("n_windows"), F.array_max(s).alias("last_start"), F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("start_sum")))
    return table(spark, sf_dir, "documents").select("doc_id", one.alias("x")).select("doc_id", "x.*")


def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window's tokens become their hash within the row of the text; only that is a row of its own."""
    labels = lambda starts: text.window_labels(F.col("text"), F.col("parts"), starts=starts)
    zipped = lambda t, s: F.arrays_zip(s.alias("start"), F.transform(s, lambda x: F.least(F.size(t) - x, F.lit(text.WINDOW))).alias("n_tokens"), labels(s).alias("label"), F.transform(text.window_texts(t), F.md5).alias("tokens_md5"))
    of = lambda t: text.let(text.window_starts(F.size(t)), lambda s: zipped(t, s))
    return all_parts(spark, sf_dir).select("doc_id", F.inline(text.let(text.tokens(F.col("text")), of)).alias("start", "n_tokens", "label", "tokens_md5"))


def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = text.window_labels(F.col("text"), F.col("parts"))
    one = text.let(labels, lambda y: F.struct(F.size(y).alias("windows"), F.aggregate(y, F.lit(0), lambda s, x: s + x).alias("positive")))
    return all_parts(spark, sf_dir).select("doc_id", one.alias("x")).select("doc_id", "x.*")


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by language and label, without an exchange of windows: labels are summed in their row."""
    labels = text.window_labels(F.col("text"), F.col("parts"))
    one = text.let(labels, lambda y: F.struct(F.size(y).alias("n"), F.aggregate(y, F.lit(0), lambda s, x: s + x).alias("p")))
    sums = all_parts(spark, sf_dir).select("lang", one.alias("x"))
    return sums.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("x.n").alias("windows"), F.sum("x.p").alias("positive"))


def badpart_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_parts(spark, sf_dir).select("doc_id", F.inline(text.part_spans(F.col("text"), F.col("parts")))).select("doc_id", F.col("a").alias("span_start"), F.col("b").alias("span_end"))


def _balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = text.window_labels(F.col("text"), F.col("parts"))
    rows = with_parts(spark, sf_dir)
    rows = rows.select("doc_id", F.size(text.tokens(F.col("text"))).alias("tokens"), text.part_token_count(F.col("text"), F.col("parts")).alias("part_tokens"), text.let(y, lambda v: F.struct(F.size(v).alias("n"), F.aggregate(v, F.lit(0), lambda s, x: s + x).alias("p"))).alias("x"))
    share = F.col("part_tokens") / F.col("tokens")
    return rows.select("doc_id", "tokens", "part_tokens", F.col("x.p").alias("positive"), (F.col("x.n") - F.col("x.p")).alias("negative"), share.alias("share"))


def window_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balance(spark, sf_dir)


def window_balance_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = (F.col("tokens") - F.col("part_tokens")) / F.col("tokens")
    why = policy.balance_reasons(F.col("tokens"), F.col("positive"), F.col("negative"), pycode.round_binary(F.col("share")), pycode.round_binary(kept))
    return _balance(spark, sf_dir).select("doc_id", F.array_join(why, ";").alias("reasons"))


def window_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four windows of each document and label by hash rank, chosen within the row: windows aren't exchanged."""
    files = all_parts(spark, sf_dir).select(F.lit("real").alias("dataset"), F.col("lang").alias("mode"), F.col("doc_id").cast("string").alias("group_id"), F.col("source").alias("filename"), F.col("text").alias("source"), F.col("parts").alias("badparts"))
    out = release.windows_of(files)
    return out.select(F.col("group_id").cast("bigint").alias("doc_id"), "label", "start", "n_windows", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def corpus_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the order of an id that is sparse, and null for some."""
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 11 > 0, F.col("doc_id") * 1_000_003).alias("place"), "doc_id", "text")
    return corpus_chunks(rows, ["place", "doc_id"], F.col("text"))


def changed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines as a diff: odd ones removed, even ones added."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.when(i % 2 == 1, F.lit("-")).otherwise(F.lit("+")), x))
    d = joined(lines)
    out = table(spark, sf_dir, "documents").select("doc_id", text.changed_parts(d, "-").alias("old"), text.changed_parts(d, "+").alias("new"))
    return out.select("doc_id", F.size("old").alias("removed"), F.size("new").alias("added"), sha(joined(F.concat("old", "new"))).alias("parts_sha"))


def string_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.string_list(F.split("text", "\n", -1))
    one = text.let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), sha(joined(x)).alias("lines_sha")))
    return table(spark, sf_dir, "documents").select("doc_id", one.alias("x")).select("doc_id", "x.*")


def marker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.marker_lines(F.col("html"), ["<SCRIPT", "<article", "onclick"])
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).alias("n_lines"), sha(joined(found)).alias("lines_sha"))


def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    reply = F.when(F.col("event_id") % 3 == 0, fenced).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Result: "), F.col("props"), F.lit(" done"))).otherwise(F.col("event_type"))
    got = F.get_json_object(text.json_object(reply), "$.k").cast("bigint")
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 3).alias("shape"), got.alias("k"))
    return rows.groupBy("shape").agg(F.count("*").alias("n"), F.count("k").alias("parsed"), F.sum("k").alias("total"))


# --- duplicates --------------------------------------------------------------------------------


def exact_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.pair_hash(F.col("text"), F.col("lang")).alias("pair_hash"))
    return rows.groupBy("pair_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def _shingled(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("ord"), "lang", text.pair_hash(F.col("text"), F.col("lang")).alias("pair_hash"), text.shingles(text.tokens(F.col("text"))).alias("items"), *more)


def shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shingled(spark, sf_dir).select(F.col("ord").alias("doc_id"), F.size("items").alias("n_shingles"), F.array_min("items").alias("least"), F.array_max("items").alias("greatest"))


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.jaccard_pairs(_shingled(spark, sf_dir), "lang", "items").select(F.col("ord").alias("doc_id"), F.col("earlier").alias("earlier_id"), "similarity")


def _policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the distinct words for a second key across languages, and every seventh document accepted beforehand."""
    prints = F.sha2(F.array_join(F.array_sort(F.array_distinct(text.tokens(F.lower("text")))), " "), 256)
    rows = _shingled(spark, sf_dir, prints.alias("words"), (F.col("doc_id") % 7 == 0).alias("pinned"))
    return dedup.duplicate_policy(rows, "pair_hash", "words", "lang", "items", pinned="pinned")


def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir).select(F.col("ord").alias("doc_id"), "accepted", F.col("check").alias("failed_check"), F.col("matched").alias("matched_id"))


def dup_policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.coalesce("check", F.lit("accepted"))
    return _policy(spark, sf_dir).groupBy(kinds.alias("outcome")).agg(F.count("*").alias("n"))


# --- selection -----------------------------------------------------------------------------------


def stable_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", selection.stable_rank(F.col("doc_id").cast("string")).alias("rank"))


def commit_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.commit_cap(commits(spark, sf_dir), "mode", "group_id", CAP).select("mode", "group_id", "turn")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.commit_split(commits(spark, sf_dir), ["mode"], "group_id")


def commit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = commits(spark, sf_dir).groupBy("mode", "group_id").agg(F.count("*").alias("files"))
    return files.join(_split(spark, sf_dir), ["mode", "group_id"]).groupBy("mode", "split").agg(F.count("*").alias("groups"), F.sum("files").alias("files"))


def audit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.audit_pairs(records(spark, sf_dir).drop("text"), "source", FIELDS, "doc_id", AUDIT).select("source", "audit_rank", "doc_id")


def balanced_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.balanced_rounds(records(spark, sf_dir).drop("text"), "source", FIELDS, "doc_id").select("doc_id", "source", "round")


def balanced_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.balanced_select(records(spark, sf_dir).drop("text"), "source", FIELDS, "doc_id", PER_MODE)


# --- planning and coverage ---------------------------------------------------------------------------


def compatible_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [tuples(spark, p).withColumn("profile", F.lit(p)) for p in ("compact", "window_balanced")]
    return both[0].unionByName(both[1]).groupBy("mode", "profile", "application_type", "structure").agg(F.count("*").alias("contexts"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records of the classes: a context by doc_id."""
    pick = lambda xs, k: F.get(F.array(*map(F.lit, xs)), (F.floor(F.col("doc_id") / k) % len(xs)).cast("int"))
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        pick(MODES, 1).alias("mode"), pick(["Flask", "Django", "API"], 7).alias("application_type"), pick(["direct", "indirect"], 21).alias("flow_pattern"),
        pick(["class_based", "single_function"], 5).alias("structure"), pick(["easy", "medium", "hard"], 11).alias("difficulty"), F.col("doc_id").cast("int").alias("sample_index"),
    )


def existing_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.existing_counts(_placed(spark, sf_dir))


def coverage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of 40 more records for a class than the largest one has."""
    rows = _placed(spark, sf_dir)
    most = rows.groupBy("mode").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return planner.plan(rows, most + 40)


def coverage_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return reports.coverage(rows, rows.select(F.col("source").alias("mode")).distinct(), "source", FIELDS).where("field <> 'context'")


def coverage_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("mode", F.lower("lang"))
    return reports.coverage(rows, dimension(spark), "mode", ["source", "quality", "toxic"]).where("field in ('context', 'total')")


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.value_counts(records(spark, sf_dir), ["source", *FIELDS])


def uncovered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    grid = rows.select("source").distinct().crossJoin(rows.select("lang").distinct())
    return reports.uncovered(grid, rows.where("toxic = '1'"), "source", "lang")


def next_sample_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of other prefixes, with letters, or with more behind their number don't count."""
    n, d = F.format_string("%06d", F.col("doc_id")), F.col("doc_id")
    ids = F.concat(F.when(d % 4 == 3, F.lit("other_")).otherwise(F.concat("source", F.lit("_"))), n, F.when(d % 4 == 2, F.lit("-draft")).otherwise(F.lit("")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(planner.next_sample_id(ids, F.concat("source", F.lit("_"))).alias("next_id"))


# --- policy -------------------------------------------------------------------------------------------


def rejection_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the whole text are the reasons."""
    rows = reviews(spark, sf_dir)
    why = F.split("text", "\n", -1)
    check = F.when(F.col("toxic") == 1, "near_duplicate").otherwise("")
    r = F.col("review")
    c = policy.rejection_category(check, r["required"], r["status"], r["verdict"], F.col("n_chars") % 3 > 0, F.concat(why, F.array(F.when(F.length("text") % 5 == 0, "tool").when(F.length("text") % 5 == 1, "badparts").otherwise(""))))
    return rows.groupBy(c.alias("category"), "lang").agg(F.count("*").alias("n"))


def revalidation_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the texts with messages in them."""
    messages = ["rules of other classes reported after the fix: x", "expected rules still reported after the fix: x", "expected lint ids still reported after the fix: x", "after: no path-safe containment", "no passing verdict of a reviewer", "the record could not be reconstructed", "too few tokens"]
    lines = table(spark, sf_dir, "documents").select("lang", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    message = F.concat("line", F.lit(" "), F.get(F.array(*map(F.lit, messages)), (F.length("line") % len(messages)).cast("int")))
    return lines.groupBy(policy.revalidation_category(message).alias("category"), "lang").agg(F.count("*").alias("n"))


def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.review_summary(reviews(spark, sf_dir), ["source"], "review")


def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.status_counts(reviews(spark, sf_dir), "review")


def review_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir).where("review is not null")
    return rows.groupBy("lang").agg(F.count_if(policy.review_consistent(F.col("review"))).alias("consistent"), F.count_if(policy.review_passed(F.col("review"))).alias("passed"), F.count("*").alias("n"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tool runs: ``tool, phase, code, body, state``."""
    k = F.col("event_id") % 5
    body = F.when(k == 0, F.col("props")).when(k == 1, F.lit("")).otherwise(F.concat(F.lit('{"results": ['), F.col("props"), F.lit("]}")))
    state = F.when(F.col("event_type") == "error", "missing").when(F.col("event_id") % 11 == 0, "timeout").otherwise("completed")
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool"), F.when(F.col("user_id") % 2 == 0, "before").otherwise("after").alias("phase"), (F.col("event_id") % 3).cast("int").alias("code"), body.alias("body"), state.alias("state"))


def tool_status_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).withColumn("status", policy.tool_status(F.col("code"), F.col("body"), "results", F.col("state")))
    return rows.groupBy("tool", "phase", "status").agg(F.count("*").alias("n"))


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = policy.tool_status(F.col("code"), F.col("body"), "results", F.col("state"))
    rows = _runs(spark, sf_dir).select("tool", s.alias("s"), F.when(F.col("code") == 2, F.lit("trace\nlast line\n")).otherwise("").alias("error"))
    m = policy.availability_message("scanner", F.lit("success"), F.col("s"), F.col("error"))
    return rows.groupBy("tool", F.coalesce(m, F.lit("ran")).alias("message")).agg(F.count("*").alias("n"))


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three states, and warnings, per class; a warning for each run of a lint tool that missed its ids."""
    ids = F.filter(F.array(*[F.when(F.col("doc_id") % p == 0, F.lit(f"B60{p}")) for p in (2, 3, 5)]), lambda x: x.isNotNull())
    after = F.when(F.col("n_chars") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("B602")))
    rows = records(spark, sf_dir).select("lang", policy.lint_verdict(F.array(F.lit("B602"), F.lit("B605")), ids, after, F.col("quality") != "unknown").alias("v"), "quality")
    failed = F.size("v.reasons") > 0
    known = F.col("quality") != "unknown"
    return rows.groupBy("lang").agg(F.count_if(known & ~failed).alias("passed"), F.count_if(known & failed).alias("failed"), F.count_if(~known).alias("missing"), F.count_if(F.size("v.warnings") > 0).alias("warned"), F.sum(F.size("v.warnings")).alias("warnings"))


def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dimension(spark)
    every = F.array(*map(F.lit, sorted({r for row in d.collect() for r in row["rule_ids"]})))  # the seven classes
    rows = _placed(spark, sf_dir).join(F.broadcast(d), "mode")  # seven rows
    left = F.when(F.col("sample_index") % 3 == 0, F.slice("rule_ids", -1, 1)).when(F.col("sample_index") % 3 == 1, F.array(F.lit("rules.cwe-79.xss"))).otherwise(F.array().cast("array<string>"))
    before = F.when(F.col("sample_index") % 2 == 0, F.col("rule_ids")).otherwise(F.array().cast("array<string>"))
    v = policy.rule_verdict(F.col("mode"), F.col("rule_ids"), every, before, left, F.lit(True), F.col("sample_index") % 5 > 0)
    out = rows.select("mode", v.alias("v"))
    return out.groupBy("mode").agg(F.sum(F.size("v.warnings")).alias("warnings"), F.sum(F.size("v.reasons")).alias("reasons"), F.count_if(F.size("v.reasons") == 0).alias("passed"))


def slot_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("slot"), F.col("turn").alias("attempt"), ((F.col("role") == "assistant") & (F.length("text") % 3 == 0)).alias("accepted"))
    return policy.slot_outcomes(attempts)


# --- harmless values --------------------------------------------------------------------------------------


def safe_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", safe.safe_value(F.split_part(F.col("url"), F.lit("/"), F.lit(-1))).alias("last_part"), safe.safe_value(F.concat(F.lit(" "), F.split_part(F.col("url"), F.lit("/"), F.lit(3)), F.lit("\t"))).alias("host"))
    return rows.select("*", safe.safe_value(F.col("page_id") % 3).alias("number"), safe.safe_value((F.col("page_id") % 3).cast("string")).alias("numeral"), safe.safe_value(F.col("page_id") % 2 == 0).alias("truth"))


def safe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text, and each of its lines."""
    whole = safe.safe_text(F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit(" C:/x")).otherwise(F.lit(""))))
    each = F.transform(F.split("text", "\n", -1), lambda x: safe.safe_text(x))
    # array_join passes nulls over.
    one = text.let(each, lambda x: F.struct(F.size(F.filter(x, lambda y: y.isNull())).alias("unsafe_lines"), sha(joined(x)).alias("lines_sha")))
    return table(spark, sf_dir, "documents").select("doc_id", sha(whole).alias("text_sha"), one.alias("x")).select("doc_id", "text_sha", "x.*")


def safe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") - 20
    return table(spark, sf_dir, "events").select("event_id", safe.safe_integer(F.floor(v)).alias("whole"), safe.safe_float(v / 7).alias("real"))


def relative_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"//[^/]+(.*)$", 1)
    odd = F.when(F.col("page_id") % 4 == 0, path).when(F.col("page_id") % 4 == 1, F.concat(F.lit("src"), path)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("C:\\app\\"), F.replace(path, F.lit("/"), F.lit("\\")))).when(F.col("page_id") % 8 == 3, F.concat(F.lit("C:app"), path)).when(F.col("page_id") % 16 == 7, F.lit("a/..")).otherwise(F.concat(F.lit("a/.."), path))
    return table(spark, sf_dir, "pages").select("page_id", safe.relative_filename(odd).alias("filename"))


def fold_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit(" Path_Disclosure")).when(F.col("doc_id") % 3 == 1, F.upper("source")).otherwise(F.lit(None))
    p = F.when(F.col("doc_id") % 2 == 0, F.lit(" Window_Balanced ")).otherwise(F.col("lang"))
    rows = table(spark, sf_dir, "documents").select(safe.fold_mode(raw).alias("mode"), safe.fold_profile(p, "compact").alias("planned"), safe.fold_profile(p, "unknown").alias("verified"))
    return rows.groupBy("mode", "planned", "verified").agg(F.count("*").alias("n"))


def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the rule set's name twice in one id, and an id that is known with it in front."""
    t = F.col("event_type")
    ids = F.array(F.concat(F.lit("x.other."), t), t, F.lit(" "), F.lit("/tmp/x"), F.concat(F.lit("b.rules."), t), F.concat(F.lit("c.rules.d.rules."), t), F.concat(F.lit("known.rules."), t))
    known = ["known.rules.click"]
    return table(spark, sf_dir, "events").select(joined(safe.finding_ids(F.transform(ids, lambda x: safe.rule_id(x, "rules", known)))).alias("ids")).groupBy("ids").agg(F.count("*").alias("n"))


# --- reports, export, integrity ---------------------------------------------------------------------------------


def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.row_index(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("text_sha", sha(F.col("text")))
    return reports.last_wins(rows, "conv_id", "turn", ["role", "text_sha"])


def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.duplicate_ids(table(spark, sf_dir, "conversations"), "conv_id")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reports.row_index(table(spark, sf_dir, "documents").withColumn("mode", F.col("lang")), "mode", "doc_id")
    code = F.col("text")
    return export.flat_commits(docs.select(
        "mode", "row_index", F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("id"), F.col("source").alias("commit_message"), F.concat(F.lit("/srv/"), F.col("source"), F.lit(".py")).alias("filename"),
        code.alias("vulnerable_code"), F.upper(code).alias("fixed_code"), F.lit("").alias("diff"), F.array("lang", "source").alias("badparts"), F.array(F.lit("x")).alias("goodparts"),
    ))


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(spark, sf_dir).select("mode", "repo", "commit_id", "msg", "filename", sha(F.col("before")).alias("before_sha"))


def nested_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout a commit a line, read back by its schema."""
    lines = export.commit_lines(_exported(spark, sf_dir))
    one = F.concat(F.lit("{"), F.to_json(F.struct(F.col("repo").alias("r"))).substr(F.lit(6), F.length("repo") + 2), F.lit(": {"), F.to_json(F.struct(F.col("commit_id").alias("r"))).substr(F.lit(6), F.length("commit_id") + 2), F.lit(": "), F.col("json"), F.lit("}}"))
    flat = export.flatten(lines.select("mode", one.alias("json")))
    return flat.select("mode", "repo", "commit_id", "filename", "msg", sha(F.col("source")).alias("source_sha"), F.size("badparts").alias("n_badparts"))


def integrity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents against a tampered copy: some texts changed, some rows gone, some renumbered."""
    docs = table(spark, sf_dir, "documents")
    other = docs.where("n_chars % 13 > 0").select(F.when(F.col("n_chars") % 17 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("n_chars") % 11 == 0, F.lower("text")).otherwise(F.col("text")).alias("text"))
    return reports.difference(docs, other, ["doc_id"], sha(F.col("text")))


def link_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "conversations").select(F.lit("r").alias("repo"), F.col("conv_id").cast("string").alias("commit_id"), F.concat(F.lit("f"), F.col("turn")).alias("filename"), "turn")
    side = files.withColumn("filename", F.concat(F.lit("f"), F.col("turn") + 1))
    return export.broken_links(side, files).select("repo", "commit_id", "filename")


# --- evaluation -------------------------------------------------------------------------------------------------------


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    p = F.col("n_chars") % 1000 / 1000
    return rows.select("lang", "source", F.col("quality").alias("truth"), metrics.threshold(p).alias("guess"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_guesses(spark, sf_dir), ["lang"])


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metrics(metrics.confusion(_guesses(spark, sf_dir), ["lang"]), ["lang"])


def mean_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.metrics(metrics.confusion(_guesses(spark, sf_dir), ["source", "lang"]), ["source", "lang"])
    return rows.groupBy("source").agg(F.round(F.avg("macro_f1"), 9).alias("mean_macro_f1"))


def conditions_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = F.when(F.col("conv_id") % 2 == 0, "real").otherwise("synthetic")
    split = F.get(F.array(*map(F.lit, ("train", "validation", "test"))), (F.col("turn") % 3).cast("int"))
    rows = table(spark, sf_dir, "conversations").select(dataset.alias("dataset"), split.alias("split"))
    return metrics.conditions(rows).groupBy("condition", "role", "dataset").agg(F.count("*").alias("n"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.vocabulary(table(spark, sf_dir, "documents").select(text.tokens(F.col("text")).alias("tokens")), "tokens", VOCABULARY_MIN)


def token_id_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))
    ids = metrics.token_ids(rows, "doc_id", "tokens", vocabulary(spark, sf_dir))
    return ids.select("doc_id", F.size(F.filter("ids", lambda i: i > 0)).alias("known"), sha(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("ids_sha"))


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' mean vector over the vectors that their events' properties point at."""
    words = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("token"), F.col("embedding").alias("vector"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("who"), F.get_json_object("props", "$.k").alias("token"))
    return metrics.mean_pool(events, "who", words, 64).select("who", "dim", F.round("value", 6).alias("value"))


# --- code ------------------------------------------------------------------------------------------------------------------


def rule_regex_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("return '"), F.col("html"), F.lit("' + "), F.when(F.col("page_id") % 3 == 0, F.lit("escape(x)")).when(F.col("page_id") % 3 == 1, F.lit("redirect(next_url)")).otherwise(F.lit("csrf.exempt")))
    return table(spark, sf_dir, "pages").select(F.explode(rules.pattern_findings(code)).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over the texts as a docstring, with a snippet behind."""
    snippet = F.get(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % len(SNIPPETS)).cast("int"))
    code = F.concat(F.lit('def f(x):\n    """'), F.replace("text", F.lit("\\"), F.lit("/")), F.lit(' """'), snippet)
    return table(spark, sf_dir, "documents").select(F.explode(scan.scan(code)).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.concat(F.col("text"), F.get(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % len(SNIPPETS)).cast("int")))
    tests = {"sql": rules.sql_injection, "shell": rules.shell_call, "listed": rules.listed_subprocess, "path": rules.path_traversal, "contained": rules.path_containment, "redirect": rules.open_redirect, "validated": rules.redirect_validation, "dynamic": rules.dynamic_code, "xss": rules.xss, "xss_fix": rules.xss_fix, "csrf": rules.csrf_issue, "csrf_fix": rules.csrf_fix, "csrf_order": rules.csrf_order}
    flags = table(spark, sf_dir, "documents").select("lang", *[t(c).alias(n) for n, t in tests.items()])
    return flags.groupBy("lang").agg(*[F.count_if(n).alias(n) for n in tests])


SNIPPETS = [
    "\ncursor.execute(f'SELECT * FROM t WHERE a={x}')",
    "\nsubprocess.run([cmd])",
    "\nos.system(x) or redirect(url)",
    "\nopen(request.args['p'])",
    "\np = base.joinpath(x).resolve()\nif not p.is_relative_to(base): pass",
    "\nrender_template_string('<b>' + x)\neval(x)",
    "\n@app.post('/x')\ndef f(): return escape(x)",
    "\nCSRFProtect(app)\napp = Flask(__name__)",
]


def unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pycode.unified_diff(F.col("before"), F.col("after"), F.lit("turn.py"))
    out = edits(spark, sf_dir).select("conv_id", "turn", d.alias("d"))
    return out.select("conv_id", "turn", F.size(text.changed_parts(F.col("d"), "-")).alias("removed"), F.size(text.changed_parts(F.col("d"), "+")).alias("added"), sha(F.col("d")).alias("diff_sha"))


def ast_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts within code of several forms, and as they are; each distinct one is parsed once."""
    forms = ["def {0}(x):\n    return x + {1}\n    r'''{2}'''", "def {0}(y): return y - {1}", "class {0}:\n    n = {1}", "{0} = [z * {1} for z in q]", "{0} = ({1}", "{2}"]
    form = F.get(F.array(*map(F.lit, forms)), (F.col("doc_id") % len(forms)).cast("int"))
    code = F.replace(F.replace(F.replace(form, F.lit("{0}"), F.col("source")), F.lit("{1}"), (F.col("n_chars") % 10).cast("string")), F.lit("{2}"), F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), F.xxhash64(code).alias("h"))
    prints = docs.groupBy("h").agg(F.first("code").alias("code")).select("h", pycode.tree_fingerprint(F.col("code")).alias("tree"))
    return docs.select("doc_id", "h").join(prints, "h").groupBy("tree").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def python_token_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", pycode.code_tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.size(text.shingles(F.col("t"))).alias("n_shingles"))


def structural_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as a docstring within fixture pairs, against the class, application and structure that the record asks for."""
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("sample_index") % len(xs)).cast("int"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("sample_index"), F.replace("text", F.lit("\\"), F.lit("/")).alias("text"))
    rows = _placed(spark, sf_dir).join(texts, "sample_index")
    code = lambda lead, snippets: F.concat(F.lit(f'{lead}\n    """'), F.col("text"), F.lit(' """'), pick(snippets))
    rows = rows.withColumns({"before": code("import sys\ndef f():\n    x = sys.argv[1]", SNIPPETS), "after": code("def f(x):\n    pass", SNIPPETS[::-1])})
    seen = rows.withColumns({"seen": rules.facts(F.col("before")), "fixed": rules.facts(F.col("after"))})
    why = rules.structural_reasons(*map(F.col, ("mode", "application_type", "flow_pattern", "structure", "before", "after", "seen", "fixed")))
    return seen.select("mode", F.explode(why).alias("reason")).groupBy("mode", "reason").agg(F.count("*").alias("n"))


# --- verification, candidates, releases, models ----------------------------------------------------------------------------


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.coverage_summary(log(spark, sf_dir))


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.validation_summary(log(spark, sf_dir))


def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of documents in English count as accepted, those of others as rejected."""
    rows = log(spark, sf_dir)
    return verify.review_summary(rows.where("provider = 'en'"), rows.where("provider <> 'en'"))


def rejection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.rejection_summary(log(spark, sf_dir))


def record_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.record_issues(log(spark, sf_dir)).groupBy("stage", "code", "mode").agg(F.count("*").alias("n"), F.count("sample_id").alias("named"))


def export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.export_counts(log(spark, sf_dir))


def sidecar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = lambda p: F.get_json_object("json", f"$.{p}")
    fields = ["id", "generation_profile", "context.application_type", "context.flow_pattern", "validation_summary.passed", "validation_summary.reason_count", "validation_summary.structural.vulnerable_markers[0]", "validation_summary.bandit.before.status", "validation_summary.semgrep.after.finding_ids[0]", "review_summary.verdict"]
    return export.sidecar(log(spark, sf_dir)).select("mode", "row_index", "commit_id", *[j(f).alias(f.replace(".", "_").replace("[0]", "")) for f in fields])


def integrity_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against an export of which some commits, some sidecar rows and two files were changed or lost."""
    rows = log(spark, sf_dir)
    plain = export.commit_lines(export.exported(rows)).where("not (mode = 'xss' and commit_id like '%8')")
    plain = plain.withColumn("json", F.when((F.col("mode") == "sql") & F.col("commit_id").endswith("9"), F.lit("{}")).otherwise(F.col("json")))
    side = export.sidecar(rows).withColumn("filename", F.when(F.col("commit_id").endswith("77"), F.lit("lost.py")).otherwise(F.col("filename")))
    files = [f"plain_{m}" for m in MODES[1:]] + ["plain_odd"]
    return verify.integrity_issues(rows, plain, side, files).groupBy("code", "mode").agg(F.count("*").alias("n"))


def dataset_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every summary, and the issues by code, of documents as a log and its own export."""
    rows = log(spark, sf_dir)
    summary, issues = verify.verify(rows.where("ord % 3 > 0"), rows.where("ord % 3 = 0"), export.commit_lines(export.exported(rows.where("ord % 3 > 0"))), export.sidecar(rows.where("ord % 3 > 0")))
    return summary.unionByName(issues.groupBy(F.lit("issues").alias("section"), F.col("code").alias("key")).agg(F.count("*").alias("value")))


def diversity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return verify.diversity_summary(rows, verify.duplicate_decisions(rows))


def revalidation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return revalidation.summary(revalidation.revalidate(rows))


def coverage_plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a plan of 40 more records for a class than the largest one has; every third of the planned slots counts as accepted."""
    rows = _placed(spark, sf_dir)
    plan = coverage_plan(spark, sf_dir)
    return coverage.plan_summary(rows, plan, plan.where("sample_index % 3 = 0"))


def plan_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.marginals(planner.existing_counts(_placed(spark, sf_dir)))


def candidate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that hold the turns of a conversation as code before and after; some are fenced, some lack a field, some aren't JSON."""
    rows = edits(spark, sf_dir)
    body = F.struct(F.when(F.col("turn") % 5 > 0, F.concat(F.lit(" fix "), F.col("turn"))).alias("commit_message"), F.when(F.col("turn") % 2 == 0, "a/b").alias("filename"), F.replace("before", F.lit("\n"), F.lit("\r\n")).alias("vulnerable_code"), F.col("after").alias("fixed_code"), F.array(F.split_part("before", F.lit("\n"), F.lit(1))).alias("vulnerable_lines"))
    reply = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("```json\n"), F.to_json(body), F.lit("\n```"))).when(F.col("conv_id") % 4 == 1, F.concat(F.lit("Here: "), F.to_json(body))).when(F.col("conv_id") % 8 == 2, F.lit("no {json")).otherwise(F.to_json(body))
    out = candidates.normalise(rows.select("conv_id", "turn", reply.alias("reply"), F.lit("sql").alias("mode")), "reply", "mode")
    return out.select("conv_id", "turn", "candidate.error", "candidate.filename", "candidate.commit_message", sha(F.col("candidate.vulnerable_code")).alias("before_sha"), joined(F.slice("candidate.badparts", 1, 1)).alias("first_part"))


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that show weakness and fix, by class, in the texts with a snippet behind."""
    c = F.concat(F.col("text"), F.get(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % len(SNIPPETS)).cast("int")))
    # The lines are made once a text, not once a class and mark.
    per = lambda own, low: F.array(*[F.struct(F.lit(m).alias("mode"), F.size(candidates.vulnerable_of(F.lit(m), own, low)).alias("b"), F.size(candidates.fixed_of(F.lit(m), own, low)).alias("a")) for m in MODES])
    rows = table(spark, sf_dir, "documents").select(F.inline(text.let(text.lines(c), lambda own: text.let(F.transform(own, F.lower), lambda low: per(own, low)))))
    return rows.groupBy("mode").agg(F.sum("b").alias("before_lines"), F.sum("a").alias("after_lines"))


def response_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns within responses of several shapes."""
    t = F.col("text")
    js = lambda *cols: F.to_json(F.struct(*cols))
    shapes = [js(F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices")), js(F.array(F.struct(t.alias("text"))).alias("choices")), js(t.alias("response")), js(F.array(F.struct(F.array(F.struct(t.alias("text")), F.struct(F.lit("end").alias("text"))).alias("content"))).alias("output")), js(t.alias("other"))]
    body = F.get(F.array(*shapes), (F.col("turn") % 5).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sha(candidates.response_text(body)).alias("text_sha"))


def parsed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir).where("review is not null")
    body = F.to_json(F.struct(*[F.col(f"review.{f}").alias(f) for f in ("verdict", *policy.VERDICT_FLAGS, "reason_category")], F.when(F.col("doc_id") % 6 == 0, 1).alias("extra")))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count(policy.parse_review(body)).alias("parsed"))


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prompts.prompt(*map(F.col, ("mode", "application_type", "flow_pattern", "structure", "difficulty", "sample_index")))
    return _placed(spark, sf_dir).select("mode", p.alias("p")).groupBy("mode").agg(F.count("*").alias("n"), F.count_distinct("p").alias("distinct_prompts"))


def release_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of commits over all conversations, their splits and windows."""
    files = commits(spark, sf_dir).select(F.when(F.col("conv_id") % 2 == 0, "real").otherwise("synthetic").alias("dataset"), "mode", "group_id", F.concat(F.lit("f"), F.col("turn")).alias("filename"), F.col("text").alias("source"), F.array(F.split_part("text", F.lit(" "), F.lit(2))).alias("badparts"))
    splits = selection.commit_split(files, ["dataset", "mode"], "group_id")
    return release.release_summary(files, release.windows_of(files).join(splits.select("group_id", "split"), "group_id"))


def missing_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = commits(spark, sf_dir).select(F.when(F.col("conv_id") % 5 == 0, "synthetic").otherwise("real").alias("dataset"), "mode", "group_id")
    return release.empty_slices(selection.commit_split(files, ["dataset", "mode"], "group_id"))


def loaded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load_records(log(spark, sf_dir).where("id is not null"))
    return rows.groupBy("mode").agg(F.count("*").alias("n"), F.count_if(F.size("badparts") > 0).alias("with_parts"), F.count_if(F.col("context.flow_pattern") == "unknown").alias("unknown_flow"), F.min("group_id").alias("first_group"))


def forest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest on the vectors: whether the label is even."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", models.array_to_vector("embedding").alias("features"), (F.col("label") % 2).cast("double").alias("label"))
    test = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    guessed = models.forest(rows.where(~test), rows.where(test), trees=20, seed=1)
    return metrics.metrics(metrics.confusion(guessed.withColumn("truth", F.col("label").cast("int")).withColumn("model", F.lit("forest")), ["model"]), ["model"])


_ALL: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    lex_tokens, token_counts, window_starts, window_rows, window_labels, label_counts, badpart_spans, window_balance, window_balance_reasons, window_cap, corpus_chunk_rows,
    changed_parts, string_lists, marker_lines, json_objects, exact_hash_dups, shingles, jaccard_pairs, greedy_dedup, dup_policy_summary, stable_rank, commit_cap, commit_split,
    split_counts, audit_pairs, balanced_rounds, balanced_select, compatible_tuples, existing_contexts, coverage_plan, coverage_marginals, coverage_tuples, value_counts,
    uncovered_values, next_sample_id, rejection_category, revalidation_category, review_summary, review_states, review_consistency, tool_status_matrix, tool_messages,
    validation_summary, rule_verdicts, slot_outcomes, safe_value, safe_text, safe_numbers, relative_filename, fold_names, finding_ids, row_index, last_wins, dup_ids,
    export_rows, nested_flatten, integrity_diff, link_check, confusion_matrix, metric_rows, mean_macro_f1, conditions_union, vocabulary, token_id_sequence, mean_pool,
    rule_regex_flags, rule_findings, text_predicates, unified_diff, ast_fingerprint, python_token_shingles, structural_checks, coverage_report, validation_report, review_report, rejection_report,
    record_issues, export_counts, sidecar_rows, integrity_issues, dataset_verification, diversity_report, revalidation_report, coverage_plan_summary, plan_marginals, candidate_fields,
    marked_lines, response_texts, parsed_reviews, prompt_texts, release_report, missing_slices, loaded_records, forest_metrics,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
