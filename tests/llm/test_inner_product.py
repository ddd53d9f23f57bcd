import numpy as np
import pytest

from catalpa.llm import inner_product as ip


def brute(rows, every=20, k=20, scale=64.0):
    kept = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, x in {i: x for i, x in reversed(kept) if i % every == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in kept if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def answer(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in ip.top_k(df, **more).select("query_id", "rank", "vec_id", "score").collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ip, "BLOCK", 40)
    monkeypatch.setattr(ip, "QUERY_BLOCK", 8)
    monkeypatch.setattr(ip, "HEAD", 30)
    monkeypatch.setattr(ip, "BANDS", 8)


def test_matches_brute_force_over_blocks(spark, small_blocks):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=32) * rng.gamma(2)).tolist()) for i in range(400)]
    assert answer(spark, rows) == brute(rows)


def test_ties_and_a_hot_vector(spark, small_blocks):
    rows = [(i, [1.0, 0.5, -0.25]) for i in range(120)] + [(200 + i, [0.1 * i, 1.0, 2.0]) for i in range(30)]
    assert answer(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (20, [0.5]), (40, []), (5, [1e30, -1e30]), (6, [-1.0, 0.0])]
    out = answer(spark, rows)
    assert {r[0] for r in out} == {0, 20, 40} and {r[2] for r in out} == {0, 20, 40, 5, 6}
    assert [r for r in out if r[0] == 40] == [(40, 1, 0, 0), (40, 2, 5, 0), (40, 3, 6, 0), (40, 4, 20, 0)]
    assert answer(spark, []) == [] and answer(spark, [(0, [1.0])]) == [] and answer(spark, [(1, [1.0])]) == []
    assert [r[2:] for r in answer(spark, [(0, [1.0]), (7, [1.0]), (7, [1.0])])] == [(7, 4096), (7, 4096)]
