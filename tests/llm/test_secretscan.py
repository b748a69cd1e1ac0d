from __future__ import annotations

import re

from sluicebox.llm.secretscan import PATTERNS, SCOPE, credential_links


def brute(docs):
    out = set()
    for doc_id, text in {(d, t) for d, t in docs if t}:
        for scope, body in enumerate(re.split(SCOPE, text)):
            found = {k: [m.span() for m in re.finditer(p, body)] for k, p in PATTERNS.items()}
            for kind in ("strong", "weak"):
                for a, b in found[kind]:
                    gaps = [max(x - b, a - y, 0) for k in ("id", "endpoint") for x, y in found[k]]
                    if kind == "strong" or gaps:
                        out.add((doc_id, scope, a, b, kind, len(found["id"]), len(found["endpoint"]), min(gaps, default=None)))
    return out


def found(df):
    return [(r.doc_id, r.scope, r.secret_start, r.secret_end, r.strength, r.n_ids, r.n_endpoints, r.distance) for r in df.collect()]


SECRET = 'token = "0123456789abcdef"'
FAR = "x " * 400
CASES = [
    (1, f"login: carol\n{SECRET}"), (2, SECRET), (3, f"login: carol\n \n{SECRET}"), (4, f"login: carol\n{'x ' * 300}{SECRET}"), (5, f"{SECRET} https://api.example.org/v1"),
    (6, "ghp_" + "a1" * 18), (7, f"a@b.org {SECRET} {SECRET} 10.0.0.1"), (8, f"{SECRET} and {FAR}a@b.org"), (None, f"AKIA{'A' * 16} {SECRET}"), (9, None), (10, ""), (1, f"login: carol\n{SECRET}"),
    (11, f"{SECRET} {FAR}https://api.example.org/v1\n{FAR}login: carol"), (12, f"{FAR}{'ghp_' + 'a1' * 18} {FAR}a@b.org"), (13, f"https://carol@host.org/?token=0123456789abcdef {SECRET}"),
]


def test_weak_parts_need_company(spark):
    got = found(credential_links(spark.createDataFrame(CASES, "doc_id bigint, text string")))
    assert len(got) == len(set(got))
    assert set(got) == brute(CASES)
    assert {g[0] for g in got} == {1, 4, 5, 6, 7, 8, 11, 12, 13, None}
    assert min(g[7] for g in got if g[0] == 8) > len(FAR)


def test_links_are_named_and_secrets_hashed(spark):
    rows = credential_links(spark.createDataFrame(CASES, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.link for r in rows}[7] == "id+secret+endpoint"
    assert all(re.fullmatch("[0-9a-f]{64}", r.secret_sha256) for r in rows)


def test_messy_tables(spark, messy, empty, nulls):
    docs = [(r.doc_id, r.text) for r in messy.collect()]
    assert set(found(credential_links(messy))) == brute(docs) != set()
    assert credential_links(empty).collect() == credential_links(nulls).collect() == []


def test_many_parts_in_one_scope(spark):
    text = " ".join(f'user{i}@x.org token = "{i:012d}"' for i in range(400))
    docs = [(1, text)]
    assert set(found(credential_links(spark.createDataFrame(docs, "doc_id bigint, text string")))) == brute(docs)
