from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from sluicebox.llm import simhash
from sluicebox.llm.simhash import PAIR_RADIUS, RADIUS, blocks, near_edges, shard_groups, shard_keys

PRINTS = "f1 bigint, f2 bigint"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def apart(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def groups(nodes, edges):
    head = {x: x for x in nodes}

    def find(x):
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for u, v in edges:
        head[find(u)] = find(v)
    found = {}
    for x in nodes:
        found.setdefault(find(x), set()).add(x)
    return sorted(sorted(g) for g in found.values())


def keys(x, radius):
    return {(mask, (x & mask) ^ flip) for mask, flip in shard_keys(radius)}


def brute(nodes):
    u = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in nodes]
    return [(nodes[i], nodes[j]) for i in range(len(u)) for j in range(i) if (u[i][0] ^ u[j][0]).bit_count() <= RADIUS and (u[i][1] ^ u[j][1]).bit_count() <= PAIR_RADIUS]


@pytest.mark.parametrize("radius", range(24))
def test_pairs_within_the_radius_share_a_key(radius):
    rng = random.Random(radius)
    assert sorted(b for bits, _ in blocks(radius) for b in bits) == list(range(64))
    for _ in range(300):
        x = rng.getrandbits(64)
        y = apart(rng, x, radius)
        assert keys(x, radius) & keys(y, radius)


def test_edges_equal_brute_force_at_every_distance(spark):
    rng = random.Random(7)
    nodes = []
    for distance in range(RADIUS + 3):
        for k in range(20):
            f1, f2 = rng.getrandbits(64), rng.getrandbits(64)
            nodes += [(f1, f2), (apart(rng, f1, distance), apart(rng, f2, PAIR_RADIUS + (k == 0)))]
    nodes = sorted({(signed(a), signed(b)) for a, b in nodes})
    got = [((r.a1, r.a2), (r.b1, r.b2)) for r in near_edges(spark.createDataFrame(nodes, PRINTS)).collect()]
    assert groups(nodes, got) == groups(nodes, brute(nodes))
    assert {frozenset(e) for e in got} == {frozenset(e) for e in brute(nodes)}


def test_hot_shards_equal_brute_force(spark):
    rng = random.Random(8)
    centre, pair = rng.getrandbits(64), rng.getrandbits(64)
    nodes = [(apart(rng, centre, rng.randrange(9)), apart(rng, pair, rng.randrange(12))) for _ in range(400)]
    nodes = sorted({(signed(a), signed(b)) for a, b in nodes})
    got = [((r.a1, r.a2), (r.b1, r.b2)) for r in near_edges(spark.createDataFrame(nodes, PRINTS)).collect()]
    assert groups(nodes, got) == groups(nodes, brute(nodes))


def test_the_tree_of_a_large_shard_finds_all(spark):
    rng = random.Random(9)
    nodes = [(rng.getrandbits(64), 0) for _ in range(300)]
    nodes += [(apart(rng, a, RADIUS), 0) for a, _ in nodes]
    f1, f2 = (np.array(x, dtype=np.uint64) for x in zip(*nodes))
    label = shard_groups(f1, f2, RADIUS, PAIR_RADIUS)
    assert groups(range(len(nodes)), enumerate(label.tolist())) == groups(range(len(nodes)), [(i, j) for i in range(len(nodes)) for j in range(i) if int(f1[i] ^ f1[j]).bit_count() <= RADIUS])


def one_shard(f1, f2):
    """The edges of the search in a single shard, as index pairs."""
    at = {x: i for i, x in enumerate(zip(f1.view(np.int64).tolist(), f2.view(np.int64).tolist()))}
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(f1), dtype=np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))], names=["shard", "f1", "f2"])
    found = [r for b in simhash._search(RADIUS, PAIR_RADIUS)([batch]) for r in b.to_pylist()]
    return [(at[r["a1"], r["a2"]], at[r["b1"], r["b2"]]) for r in found]


def all_pairs(f1, f2):
    found = []
    for i in range(len(f1)):
        near = (np.bitwise_count(f1[i + 1 :] ^ f1[i]) <= RADIUS) & (np.bitwise_count(f2[i + 1 :] ^ f2[i]) <= PAIR_RADIUS)
        found += [(i, i + 1 + int(j)) for j in np.flatnonzero(near)]
    return found


def test_a_large_shard_of_unlike_texts_takes_the_time_of_its_comparisons():
    rng = np.random.default_rng(10)
    f1, f2 = rng.integers(0, 2**63, (2, 16_000), dtype=np.uint64)
    f1[8_000:8_100], f2[8_000:8_100] = f1[:100] ^ np.uint64(0b1011), f2[:100]
    began = time.process_time()
    want = all_pairs(f1, f2)
    brute = time.process_time() - began
    got = one_shard(f1, f2)
    assert groups(range(len(f1)), got) == groups(range(len(f1)), want) and len(want) >= 100
    assert time.process_time() - began - brute < 10 * brute


def test_a_large_dense_shard_equals_all_pairs(monkeypatch):
    rng = np.random.default_rng(11)
    bit = lambda: np.uint64(1) << rng.integers(0, 64, 9_000, dtype=np.uint64)
    centre = rng.integers(0, 2**63, 450, dtype=np.uint64)
    f1, f2 = np.repeat(centre, 20) ^ bit() ^ bit(), np.repeat(centre[::-1], 20) ^ bit() ^ bit() ^ bit()
    whole = groups(range(9_000), all_pairs(f1, f2))
    assert groups(range(9_000), one_shard(f1, f2)) == whole
    monkeypatch.setattr(simhash, "LEAF", 64)
    assert groups(range(2_000), one_shard(f1[:2_000], f2[:2_000])) == groups(range(2_000), all_pairs(f1[:2_000], f2[:2_000]))


def test_a_task_contracts_its_edges(spark, monkeypatch):
    rng = random.Random(12)
    nodes = []
    for _ in range(40):
        f1, f2 = rng.getrandbits(64), rng.getrandbits(64)
        nodes += [(signed(apart(rng, f1, 2)), signed(apart(rng, f2, 3))) for _ in range(7)]
    nodes = sorted(set(nodes))
    want = groups(nodes, brute(nodes))
    for edges in (simhash.EDGES, 1):
        monkeypatch.setattr(simhash, "EDGES", edges)
        shards = spark.createDataFrame([(s, *x) for s in range(9) for x in nodes], "shard bigint, f1 bigint, f2 bigint").coalesce(1).sortWithinPartitions("shard", "f1", "f2")
        got = [((r.a1, r.a2), (r.b1, r.b2)) for r in shards.mapInArrow(simhash._search(RADIUS, PAIR_RADIUS), "a1 bigint, a2 bigint, b1 bigint, b2 bigint").collect()]
        assert groups(nodes, got) == want
        assert edges == 1 or len(got) == len(nodes) - len(want)


def test_forest_keeps_components():
    rng = np.random.default_rng(13)
    for n, m in ((2, 1), (50, 30), (300, 290), (300, 900)):
        u, v = rng.integers(0, n, (2, m))
        x = rng.integers(-(2**63), 2**63 - 1, (2, n))
        a1, a2, b1, b2 = simhash.forest(x[0, u], x[1, u], x[0, v], x[1, v])
        nodes = list(zip(*x.tolist()))
        edges = list(zip(zip(a1.tolist(), a2.tolist()), zip(b1.tolist(), b2.tolist())))
        want = groups(nodes, [(nodes[i], nodes[j]) for i, j in zip(u, v)])
        assert groups(nodes, edges) == want and len(edges) == n - len(want)
    chain = np.arange(1000)[::-1]
    assert (simhash.forest(chain[1:], chain[1:], chain[:-1], chain[:-1])[0] == 0).all()
