import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalpa.llm import centroids as ct

SALT = "2:"


def floor(x, scale):
    return max(-(2**63), min(2**63 - 1, int(np.floor(scale * float(np.float32(x))))))


def brute(rows, k, rounds, scale, width):
    """(id, cluster, distance) and the centroids, by Python's integers and every distance."""
    kept = [(i, [floor(c, scale) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v)]
    own = [v for _, _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v, v) for i, v in kept if i is not None)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(own))
    if not own:
        return [], []
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        own = [[sum(c) // len(groups[n]) for c in zip(*groups[n])] if n in groups else c for n, c in enumerate(own)]
    return sorted(((i, near(v)[1], min(2**63 - 1, near(v)[0])) for i, v in kept), key=repr), own


def answer(spark, rows, k, rounds, scale, width):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, own = ct.cluster(df, k, rounds, scale, width, SALT)
    return sorted((tuple(r) for r in found.collect()), key=repr), own.tolist()


@pytest.mark.parametrize(("width", "k", "scale"), [(64, 12, 256.0), (7, 5, 16.0), (8, 3, 1.0), (1, 4, 2.0)])
def test_matches_brute_force(spark, width, k, scale):
    rng = np.random.default_rng(width)
    rows = [(i, (rng.normal(size=width) + 3 * (i % 4)).tolist()) for i in range(150)]
    assert answer(spark, rows, k, 3, scale, width) == brute(rows, k, 3, scale, width)


def test_ties_and_a_hot_vector(spark):
    rows = [(i, [1.0, 0.0]) for i in range(200)] + [(200 + i, [float(i % 3), 1.0]) for i in range(40)]
    assert answer(spark, rows, 20, 4, 2.0, 2) == brute(rows, 20, 4, 2.0, 2)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, [1.0]), (6, []), (7, [1e30, -1e30]), (7, [0.5, 0.5]), (8, [-3e18, 3e18]), (None, [5.0, 5.0]), (0, [1.0, 2.0])]
    assert answer(spark, rows, 3, 2, 4.0, 2) == brute(rows, 3, 2, 4.0, 2)
    assert answer(spark, rows, 40, 1, 4.0, 2) == brute(rows, 40, 1, 4.0, 2)
    assert answer(spark, [], 3, 2, 4.0, 2)[0] == [] and answer(spark, [(None, [1.0, 1.0])], 3, 2, 4.0, 2)[0] == []


def test_report_and_other_columns(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "short": F.lit("x"), "cluster": F.lit(2), "hash": F.lit(3)})
    found, own = ct.cluster(df, 4, 2, 4.0, 2, SALT)
    told = ct.report(found, own).collect()
    assert len(told) == 30 and {r["inertia"] for r in told} == {sum(r["distance"] for r in told)}
    for c in range(4):
        mine = [r for r in told if r["cluster"] == c]
        assert all(r["cluster_inertia"] == sum(m["distance"] for m in mine) and r["centroid_sha256"] == hashlib.sha256(",".join(map(str, own[c])).encode()).hexdigest() for r in mine)
    empty, none = ct.cluster(df.where("false"), 4, 2, 4.0, 2, SALT)
    assert ct.report(empty, none).collect() == []


def test_screening_saves_distances():
    """The bound holds for every pair, and vectors near a centroid need few exact distances."""
    rng = np.random.default_rng(5)
    own = (rng.normal(size=(40, 32)) * rng.gamma(2, size=(40, 1)) * 100).astype(np.int64)
    v = own[np.arange(500) % 40] + rng.integers(-9, 10, size=(500, 32))
    whole = ((v[:, None, :] - own[None, :, :]) ** 2).sum(2)
    gaps = ((ct.lengths(v)[:, None, :] - ct.lengths(own)[None, :, :]) ** 2).sum(2)
    assert (gaps <= whole + 1e-6 * (1 + whole)).all()
    cluster, best, taken = ct.nearest(v, ct.lengths(v), own)
    assert (best == whole.min(1)).all() and (cluster == whole.argmin(1)).all() and taken < whole.size / 5
