from __future__ import annotations

from pyspark.sql import functions as F

from sluicebox.llm.common import digest
from sluicebox.llm.linededup import apply_line_bitmaps, line_keep_bitmaps


def brute(df):
    """{(doc_id, text): [keep of each line]} in the order of doc_id (null first), digest and position."""
    docs = df.where("text is not null").select("doc_id", digest().alias("g"), "text").distinct().collect()
    seen, out = set(), {}
    for r in sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.g)):
        keep = []
        for line in r.text.split("\n"):
            line = line.strip()
            keep.append(not line or line not in seen)
            if line:
                seen.add(line)
        out[r.doc_id, r.g] = (r.text, keep)
    return out


def bits(runs):
    out, keep = [], True
    for n in map(int, runs.split(",")):
        out += [keep] * n
        keep = not keep
    return out


CASES = [(1, "a\nb\n\na"), (2, "b\nc\n b \nd"), (3, "a\na\na"), (None, "c"), (4, ""), (5, "\n\n"), (2, "b\nc\n b \nd"), (2, "other\nc"), (6, None), (7, "x\r\nx\ny\x1c"), (8, "y")]


def check(df):
    rows = line_keep_bitmaps(df).collect()
    want = brute(df)
    assert len(rows) == len(want)
    for r in rows:
        keep = want[r.doc_id, r.digest][1]
        assert bits(r.keep_runs) == keep, r
        assert (r.n_lines, r.n_kept) == (len(keep), sum(keep))


def test_bitmaps_equal_brute_force(spark, messy):
    df = spark.createDataFrame(CASES, "doc_id bigint, text string").repartition(4)
    check(df)
    check(messy)
    assert {r.keep_runs for r in line_keep_bitmaps(df).where("doc_id = 4").collect()} == {"1"}


def test_applied_texts(spark, messy):
    for df in (spark.createDataFrame(CASES, "doc_id bigint, text string"), messy):
        want = []
        for (doc_id, _), (text, keep) in brute(df).items():
            left = "\n".join(x for x, k in zip(text.split("\n"), keep) if k)
            if left.strip() or not text.strip():
                want.append((str(doc_id), left))
        out = apply_line_bitmaps(df, line_keep_bitmaps(df))
        assert out.columns == df.columns
        got = [(str(r.doc_id), r.text) for r in out.where("text is not null").collect()]
        assert sorted(got) == sorted(want)
        assert out.where("text is null").count() == df.where("text is null").count()


def test_many_short_runs_in_a_long_text(spark):
    text = "\n".join(f"same\nline {i}" for i in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    check(df)
    assert apply_line_bitmaps(df, line_keep_bitmaps(df)).first().text == "same\n" + "\n".join(f"line {i}" for i in range(3000))


def test_result_does_not_depend_on_partitions(messy):
    key = lambda df: sorted(map(str, line_keep_bitmaps(df).collect()))
    assert key(messy.repartition(1)) == key(messy.repartition(7, F.length("text")))


def test_empty_and_null_tables(empty, nulls):
    assert line_keep_bitmaps(empty).collect() == line_keep_bitmaps(nulls).collect() == []
    assert apply_line_bitmaps(empty, line_keep_bitmaps(empty)).collect() == []
    assert apply_line_bitmaps(nulls, line_keep_bitmaps(nulls)).count() == 3
