"""Exact top-k and nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.vectors import Best, depths, exact_top_k, nearest, one_bit_estimate, one_bit_index, op3_exact_top_k, op5_nearest_neighbours, rotation, threshold_search, unit

SF = "/root/testdata/sf0.01"


def embeddings(spark, sf=SF):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)


def brute(ids, vectors, asks, top, score):
    out = []
    for q in asks:
        own = np.flatnonzero(ids == q)[0]
        found = [(-score(vectors[own], v), i) for i, v in zip(ids, vectors, strict=True) if i != q]
        out += [(int(q), n + 1, int(i), -s) for n, (s, i) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_exact_query(spark):
    ids, vectors = embeddings(spark)
    whole = np.floor(1024 * vectors).astype(int)
    want = brute(ids, whole, ids[ids % 100 == 0], 10, lambda a, b: int(a @ b))
    assert sorted(map(tuple, op3_exact_top_k(spark, SF).collect())) == want


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [40, 150, 300])
def test_threshold_with_ties(seed, block):
    """In blocks, whose best raise the bar of the next ones."""
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-2, 3, (300, 5)).astype(float)
    ids = np.arange(300)
    best = Best(np.full(20, -np.inf), 7)
    for start in range(0, 300, block):
        at = slice(start, start + block)
        threshold_search(ids[at], vectors[at], ids[:20], vectors[:20], best)
    for query in range(20):
        all_ = sorted((-int(vectors[query] @ v), i) for i, v in enumerate(vectors) if i != query)[:7]
        assert [(-int(s), int(i)) for i, s in zip(best.ids[query], best.scores[query], strict=True)] == all_


def test_threshold_stops_early():
    """Where few components decide, few candidates are scored; the bound stops the reading."""
    rng = np.random.default_rng(4)
    vectors = np.floor(rng.standard_normal((5000, 6)) * [500, 300, 4, 2, 1, 1])
    ids = np.arange(5000)
    best = Best(np.full(50, -np.inf), 5)
    scored = threshold_search(ids, vectors, ids[:50], vectors[:50], best)
    assert scored < 0.5 * 50 * 5000 and list(depths(3)) == [3] and depths(1000)[-1] == 1000
    for query in range(50):
        assert sorted((-float(vectors[query] @ v), i) for i, v in enumerate(vectors) if i != query)[:5] == [(-s, i) for i, s in zip(best.ids[query], best.scores[query], strict=True)]


def test_blocks_of_queries_and_candidates(spark):
    """Many blocks of both, whose results are stored in between, give what one gives."""
    import tessera.llm.vectors as m

    rng = np.random.default_rng(2)
    rows = [(int(i), rng.integers(-3, 4, 6 if i % 7 else 4).astype(float).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    old, m.BLOCKS_AT_ONCE = m.BLOCKS_AT_ONCE, 2
    try:
        for search in (exact_top_k, nearest):
            want, got = (sorted(map(tuple, search(frame, "vec_id", "embedding", F.col("vec_id") % 5 == 0, 4, **sizes).collect())) for sizes in ({}, {"candidates_per_block": 30, "numbers_per_query_block": 90}))
            if search is exact_top_k:
                assert got == want
            else:
                assert len(set(got) & set(want)) > 0.9 * len(want) == 0.9 * len(got)
    finally:
        m.BLOCKS_AT_ONCE = old


def odd(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (100, None), (150, [float("nan"), 1.0]), (200, [None, 1.0]), (250, [0.0, 0.0]), (None, [1.0, 1.0]),
            (3, [1.0, 0.0]), (2, [1.0, 0.0]), (7, [1.0, 0.0, 0.0]), (300, [9.0]), (9, [float("inf"), 0.0]), (5, []), (350, [1e300, 1e300]), (0, [1.0, 0.0])]
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, `rank` string")


def test_exact_of_odd_rows(spark):
    got = {}
    for q, _, i, s in exact_top_k(odd(spark), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 3).collect():
        got.setdefault(q, []).append((i, s))
    top = (1 << 63) - 1
    assert got[0] == [(350, top), (2, 1048576), (3, 1048576)] and got[250] == [(0, 0), (0, 0), (2, 0)]
    assert got.keys() == {0, 50, 250, 350} and all(i not in (100, 150, 200, 7, 9, None) for v in got.values() for i, _ in v)
    assert exact_top_k(odd(spark).limit(0), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 3).collect() == []


def cosine(a, b):
    return float(a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_nearest_query_recall(spark, sf):
    ids, vectors = embeddings(spark, sf)
    asks = ids[ids % 50 == 0]
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    got = [tuple(r) for r in op5_nearest_neighbours(spark, sf).collect()]
    assert len(got) == 5 * len(asks)
    place = {int(i): n for n, i in enumerate(ids)}
    hits = 0
    for q in asks:
        scores = units @ units[place[q]]
        scores[place[q]] = -9
        hits += len(set(ids[np.lexsort((ids, -scores))[:5]]) & {r[2] for r in got if r[0] == q})
    assert hits / len(got) >= 0.98
    for q, _, i, s in got:
        assert abs(s - cosine(vectors[place[q]], vectors[place[i]])) < 1e-14


def test_nearest_of_odd_rows(spark):
    got = {}
    for q, _, i, s in nearest(odd(spark), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 2).collect():
        got.setdefault(q, []).append((i, s))
    assert got[0] == [(2, 1.0), (3, 1.0)] and [i for i, _ in got[50]] == [350, 0] and got.keys() == {0, 50, 350}
    assert nearest(odd(spark).limit(0), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 2).collect() == []


def test_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(1)
    _, _, units = unit(rng.standard_normal((4000, 60)))
    turn = rotation(60)
    assert np.allclose(turn @ turn.T, np.eye(60))
    codes, fit, spread = one_bit_index(units, turn)
    assert codes.dtype == np.uint8 and codes.shape == (4000, 8)
    misses = []
    for q in units[:20]:
        misses.append(np.abs(one_bit_estimate(codes, fit, q @ turn) - units @ q) > 3 * spread)
    assert np.mean(misses) < 0.01
