from __future__ import annotations

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from sluicebox.llm import tokencount
from sluicebox.llm.tokencount import token_counts
from sluicebox.llm.tokenizers import DEFAULT_PATH, PATTERN, encoding, load_ranks, merge, whole_tokens

RANKS = load_ranks(DEFAULT_PATH)
CODEC = encoding(RANKS)
WHOLE = whole_tokens(RANKS)


def check(rows, got):
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        if t is None:
            want.append((i, None, None, None, None))
        else:
            pieces = regex.findall(PATTERN, t)
            want.append((i, len(t.encode()), len(pieces), sum(p in WHOLE for p in pieces), len(CODEC.encode_ordinary(t))))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_counts_equal_the_ordinary_encoding(spark, messy):
    check([(r.doc_id, r.text) for r in messy.collect()], token_counts(messy).collect())


def test_odd_texts(spark):
    texts = ["x's 's'll", "<|endoftext|> a", "日本語のテキスト", "а б в г д", "\x00\x01", "\n\n\n \t ", "a" * 3000, "don't  stop   ", "🙂" * 50, "1234567890" * 20, " leading", "\r\n\r\n", "ﬁ ǅ ß", "é ́"]
    docs = list(enumerate(texts))
    check(docs, token_counts(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())


def test_whole_tables_of_the_smallest_size(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], token_counts(docs).collect())


def test_empty_and_null_tables(spark, empty, nulls):
    assert token_counts(empty).collect() == []
    assert [tuple(r) for r in token_counts(nulls).collect()] == [(None,) * 5] * 3


def test_the_proof_holds_for_each_whole_token():
    assert len(WHOLE) > 40_000
    for t in WHOLE:
        assert CODEC.encode_ordinary(t) == [RANKS[t.encode()]]


def test_tokens_outside_the_proof_are_no_single_token_alone():
    for t in RANKS:
        try:
            text = t.decode()
        except UnicodeDecodeError:
            continue
        if text not in WHOLE:
            assert len(regex.findall(PATTERN, text)) != 1 or len(CODEC.encode_ordinary(text)) != 1


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=12))
def test_merges_equal_the_codec(text):
    for piece in regex.findall(PATTERN, text):
        got = merge(piece.encode(), RANKS)
        assert b"".join(got) == piece.encode() and [RANKS[x] for x in got] == CODEC._encode_single_piece(piece)


def test_memory_does_not_change_counts(monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 2)
    memory = tokencount._Memory(RANKS)
    words = ["qzxv", "wvut", "yyzk", "qzxv", "lmnq", "wvut"]
    assert [memory[w] for w in words] == [len(CODEC.encode_ordinary(w)) for w in words]
