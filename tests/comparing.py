"""A query's rows against its SQL's, over given tables."""

from __future__ import annotations

import math
from pathlib import Path


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return bytes(v) if isinstance(v, bytearray) else v


def compare(spark, query, sql: str, folder: str) -> None:
    import duckdb

    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = query(spark, folder)
    columns = sorted(df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(str(tuple(_plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    got = sorted(str(tuple(map(_plain, r))) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == want
