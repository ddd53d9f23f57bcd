import numpy as np
import pytest
from pyspark.sql import functions as F

from catalpa.llm import hard_negatives as hn


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95, scale=256.0):
    """Every anchor against every row, by Python's integers."""
    whole = lambda v: [int(np.floor(scale * float(np.float32(c)))) for c in v]
    kept = [(i, n, whole(v)) for i, n, v in rows if i is not None and n is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for a, n, x in kept:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, m) for i, m, y in kept if i != a)
        for s, p, _ in [r for r in scored if r[2] == n][:positives]:
            fits = [r for r in scored if r[2] != n and low * -s <= 100 * -r[0] <= high * -s]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fits[:negatives])]
    return sorted(out)


def answer(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"grp": F.lit("x"), "list": F.lit(1), "v": F.lit(2.0), "region": F.lit(None).cast("string")})
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in hn.mine(df, **more).select(*columns).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(hn, "PACK", 6)
    monkeypatch.setattr(hn, "CHUNK", 16)
    monkeypatch.setattr(hn, "FIRST", 1)


def test_matches_brute_force_over_blocks(spark, small_blocks):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 16))
    rows = [(i, int(rng.integers(4)), (middle[i % 12] + 0.3 * rng.normal(size=16)).tolist()) for i in range(700)]
    want = brute(rows, every=20)
    assert len(want) > 300 and answer(spark, rows, every=20) == want


def test_a_list_visited_by_one_request_stays_open_to_others(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(hn, "PACK", 64)
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)), rng.normal(size=8).tolist()) for i in range(600)]
    want = brute(rows, every=10)
    assert len(want) > 500 and answer(spark, rows, every=10) == want


def test_ties_a_hot_vector_and_a_hot_label(spark, small_blocks):
    rows = [(i, 0 if i % 9 else 1, [1.0, 0.5, -0.25]) for i in range(150)] + [(200 + i, i % 3, [0.02 * i, 0.5, 0.2]) for i in range(100)]
    want = brute(rows, every=25)
    assert want and answer(spark, rows, every=25) == want


def test_edges(spark):
    rows = [(0, 1, [1.0, 2.0]), (1, None, [1.0, 2.0]), (2, 1, None), (3, 1, [float("nan"), 1.0]), (4, 1, [float("inf"), 1.0]), (5, 1, [None, 1.0]), (None, 1, [1.0, 2.0]), (6, 1, [0.9, 2.0])]
    rows += [(7, 2, [1.0, 1.0]), (8, 3, [1.0]), (9, 2, []), (10, 2, [2.0, 1.0, 5.0]), (50, 7, [1.0, 1.0]), (100, 8, [-1.0, -1.0]), (101, 8, [1.0, 1.0]), (150, 9, [0.0, 0.0]), (151, 9, [1.0, 0.0])]
    want = brute(rows)
    assert {r[0] for r in want} == {0, 150} and answer(spark, rows) == want  # 50 has no positive, 100 only one of a score below 0
    assert answer(spark, []) == [] and answer(spark, [(0, 1, [1.0])]) == [] and answer(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    copies = [(0, 1, [1.0]), (0, 1, [1.0]), (3, 1, [1.0]), (3, 1, [1.0]), (4, 2, [0.8]), (4, 2, [0.8])]
    assert answer(spark, copies) == sorted(2 * [(0, 3, 1, 4, 65536, 52224), (0, 3, 2, 4, 65536, 52224)])


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v, rows = rng.normal(size=(30, 8)) * 100, rng.normal(size=(500, 8)) * 100
    centres = hn.centres_of(rows, 9)
    near = ((centres**2).sum(1)[None, :] - 2 * rows @ centres.T).argmin(1)
    radii = np.array([np.sqrt(((rows[near == c] - centres[c]) ** 2).sum(1)).max(initial=0) for c in range(len(centres))])
    high, low = hn.bounds(v, centres, radii)
    scores = v @ rows.T
    assert (scores <= high[:, near]).all() and (scores >= low[:, near]).all()
    assert sorted(set(hn.regions_of(centres, 3))) == [0, 1, 2]
