from __future__ import annotations

import re

import pytest

from sluicebox.llm.decontam import DROP_SHARE, NGRAM, contamination, decontaminate

ITEM = "the quick brown fox jumps over the lazy dog and runs away from the hungry bear"
BENCH = [(1, ITEM), (2, "short item here"), (3, None), (4, ""), (5, "!!!"), (1, ITEM), (6, ITEM + " tonight")]
FILL = " ".join(f"filler{i}" for i in range(60))
DOCS = [
    (1, f"{FILL} The QUICK, brown fox; jumps over the lazy dog and runs away from the hungry bear. {FILL}"), (2, ITEM), (3, FILL), (4, f"{FILL} short item, here {FILL}"), (5, "quick brown fox jumps"),
    (6, f"{FILL} quick brown fox jumps over the lazy dog {FILL} dog and runs away from the hungry bear {FILL}"), (7, None), (8, ""), (1, FILL), (None, f"{ITEM} {FILL}"), (3, FILL), (9, "short item"),
    (10, f"İİİ Σας {FILL} {ITEM} İ {FILL} {FILL}"), (11, f"{FILL} {ITEM} {FILL}"), (11, f"{FILL} {ITEM} {FILL}"),
]
D, B = "doc_id bigint, text string", "item_id bigint, text string"


def words(t):
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", t or "")]


def spans(text, n=NGRAM, bench=None):
    w = [x[2] for x in words(text)]
    hits = set()
    for _, item in BENCH if bench is None else bench:
        b = [x[2] for x in words(item)]
        size = min(n, len(b))
        grams = {tuple(b[j : j + size]) for j in range(len(b) - size + 1)} if size else set()
        for j in range(len(w) - size + 1):
            if grams and tuple(w[j : j + size]) in grams:
                hits |= set(range(j, j + size))
    out = []
    for p in sorted(hits):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return out


def n_items(text):
    return sum(bool(spans(text, bench=[x])) for x in BENCH)


def cut(text, drop=DROP_SHARE):
    s, w = spans(text), words(text)
    if not s:
        return text
    if sum(b - a for a, b in s) / len(w) >= drop:
        return False
    for a, b in reversed(s):
        text = text[: w[a][0]] + text[w[b - 1][1] :]
    return text


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_hits_equal_brute_force_both_ways(spark, limit):
    df = contamination(spark.createDataFrame(DOCS, D), spark.createDataFrame(BENCH, B), broadcast_bytes=limit)
    got = sorted((str(r.doc_id), r.n_words, [[s.a, s.b] for s in r.spans], r.n_spans, r.hit_words, r.n_items) for r in df.collect())
    want = sorted((str(d), len(words(t)), s, len(s), sum(b - a for a, b in s), n_items(t)) for d, t in set(DOCS) if (s := spans(t)))
    assert got == want


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_cut_keeps_the_rest_as_it_was(spark, limit):
    rows = [(d, t, len(t or ""), k, "x") for k, (d, t) in enumerate(DOCS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, `a.b` int, hit_share string")
    out = decontaminate(df, spark.createDataFrame(BENCH, B), broadcast_bytes=limit)
    assert out.columns == df.columns
    got = {r["a.b"]: r for r in out.collect()}
    for k, (_, t) in enumerate(DOCS):
        want = cut(t)
        if want is False:
            assert k not in got
        else:
            assert got[k]["text"] == want
            assert got[k]["n_chars"] == (None if t is None else len(want)) or t is None


def test_many_hits_in_a_long_text(spark):
    long = f" {ITEM}. {FILL} {FILL}; " * 300
    out = decontaminate(spark.createDataFrame([(1, long)], D), spark.createDataFrame(BENCH, B)).first()
    assert out.text == cut(long)


def test_clean_and_messy_tables(spark, messy, empty, nulls):
    bench = spark.createDataFrame(BENCH, B)
    none = spark.createDataFrame([], B)
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert key(decontaminate(messy, bench)) == key(messy) == key(decontaminate(messy, none))
    assert contamination(messy, none).collect() == [] == decontaminate(empty, bench).collect()
    assert key(decontaminate(nulls, bench)) == key(nulls)
