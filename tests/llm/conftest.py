from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `digest` string, `shard` int, `toxicity` string, `a.b` int, `rank` int, `keep_runs` int"
WORDS = "river stone window garden letter summer bridge candle market forest silver thunder meadow harbor lantern".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3) + i) % len(WORDS)] + str((seed + i) % 11) for i in range(n))


def rows() -> list[tuple]:
    """Nulls, empty and very long texts, repeated rows, ties, blank texts, and columns whose names clash."""
    texts = [
        (1, prose(1, 60)), (1, prose(1, 60)), (1, "another text of the same id\nwith two lines"), (None, prose(2, 40)), (None, None), (2, None), (3, ""), (4, "   \n\n \t"),
        (5, "\n".join(prose(k % 3, 8) for k in range(400))), (6, " ".join(prose(k, 50) for k in range(600))), (7, prose(1, 60)), (8, "one"), (9, "one"), (10, "Ünï çödé — naïve text 🙂 \x1c end"),
        (11, 'user = bob\ntoken = "abcdefgh12345678"\n\npassword: hunter2hunter2'), (-5, prose(9, 30)), (2**62, prose(9, 30)),
    ]
    return [(i, t, "en", "s", len(t) if t is not None else None, "d", 1, "x", k, None, k) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def nulls(spark):
    return spark.createDataFrame([(None,) * 11] * 3, SCHEMA)
