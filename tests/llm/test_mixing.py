import numpy as np
import pytest
from llm.conftest import EDGES
from pyspark.sql import functions as F

from catalpa.llm import mixing


def goals(sizes):
    """The contract's resharing, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = np.array([(1, 2, 3)[i % 3] for i in range(len(names))], float)
    cap = 3.0 * np.array([sizes[n] for n in names])
    total, free = cap.sum() / 3, np.ones(len(names), bool)
    while True:
        want = np.where(free, (total - cap[~free].sum()) * w / max(w[free].sum(), 1e-300), cap)
        over = free & (want > cap + 1e-12)
        if not over.any():
            return dict(zip(names, want))
        free &= ~over


def mixed(make, rows):
    return mixing.mix(make(rows)).collect()


def test_targets_and_rounding(make):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.geometric(0.01))), "en", f"s{int(rng.integers(0, 5)) ** 2 % 7}") for i in range(900)]
    rows += [(2000 + i, "tiny source", "en", None) for i in range(3)]
    out = mixed(make, rows)
    size, taken, target = {}, {}, {}
    for r in out:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in {r["size"] * k for k in range(4)} and r["size"] == len(r["text"].split())
    want = goals(size)
    for s in size:
        assert target[s] == pytest.approx(want[s]) and taken[s] == pytest.approx(want[s], rel=0.01, abs=3)
    again = {r["doc_id"]: r["taken"] for r in mixed(make, rows[::-1])}
    assert again == {r["doc_id"]: r["taken"] for r in out}


def test_rates_are_exponentially_tilted(make):
    """Before rounding, log(rate) / size is one number for each source where the rate is below the cap."""
    rows = [(i, " ".join(["w"] * (1 + i % 40)), "en", "ab"[i % 2]) for i in range(400)]
    cells = make(rows).select("source", mixing.words(F.col("text")).alias("size")).groupBy("source", "size").count().withColumnRenamed("count", "n")
    goal = mixing.targets(cells).withColumnRenamed("source", "goal_source")
    solved = {r["source"]: r for r in mixing.solve(cells, goal).collect()}
    for s, r in solved.items():
        got = sum(c["n"] * c["size"] * min(3.0, np.exp(r["multiplier"] * c["size"] / r["mean"])) for c in cells.where(f"source = '{s}'").collect())
        assert got == pytest.approx(r["target"], rel=1e-6)


def test_one_cell_of_copies_in_buckets(make, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_BUCKET", 7)
    rows = [(i, "same text here", "en", "a") for i in range(300)] + [(1000 + i, "b b", "en", "b") for i in range(300)]
    out = mixed(make, rows)
    assert sum(r["taken"] for r in out if r["source"] == "a") == pytest.approx(500, abs=3)
    assert sum(r["taken"] for r in out if r["source"] == "b") == pytest.approx(1000, abs=3)


def test_edges(make, spark):
    docs = make(EDGES, clash=True)
    out = mixing.mix(docs).collect()
    assert len(out) == len(EDGES) and all(r["taken"] <= 3 * r["size"] for r in out)
    assert {r["size"] for r in out if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix(docs.where("false")).count() == 0
    assert set(mixing.repeat(docs).columns) == set(docs.columns)
    assert mixing.mix(docs.where("doc_id = 1")).collect()[0]["taken"] == 0
    blank = make([(1, "a\tb\x0bc\x0cd\r\ne  f g h", "en", "a")])
    assert mixing.mix(blank).collect()[0]["size"] == 6
