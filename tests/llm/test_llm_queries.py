from __future__ import annotations

import pytest
from comparing import compare

from sluicebox.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_those_of_the_sql(spark, name):
    compare(spark, queries.queries()[name], SQL[name], "/root/testdata/sf0.001")


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert len(names) == len(set(names)) and set(SQL) <= set(names)
