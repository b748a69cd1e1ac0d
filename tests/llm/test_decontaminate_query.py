from __future__ import annotations

from test_decontam import BENCH, DOCS, B, D, cut

from sluicebox.llm.queries import queries


def test_the_registered_query_cuts_the_texts(spark, tmp_path):
    rows = [(d, t, len(t) if t is not None else None, k) for k, (d, t) in enumerate(DOCS)]
    spark.createDataFrame(rows, D + ", n_chars bigint, k int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, B).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in queries()["op4_decontaminate"](spark, str(tmp_path)).collect()}
    texts = [(d, cut(t), k) for k, (d, t) in enumerate(DOCS)]
    assert got == {(d, t, len(t) if t is not None else None, k) for d, t, k in texts if t is not False}
    assert any(t is False for _, t, _ in texts) and any(t not in (False, DOCS[k][1]) for _, t, k in texts)
