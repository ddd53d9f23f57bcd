"""Levels, cycles and places of plans, against plain Python."""

import random
from functools import cache
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catalpa.plans import order, steps
from catalpa.session import shared


def brute(edges, names):
    """name -> (level, component): the longest chain below, or the least name of its cycle."""
    needs = {n: {m for a, m in edges if a == n and m in names and m != n} for n in names}
    reach = {n: set(needs[n]) for n in names}
    for k in names:
        for n in names:
            if k in reach[n]:
                reach[n] |= reach[k]
    ring = {n: min(m for m in names if m in reach[n] and n in reach[m]) for n in names if n in reach[n]}
    late = {n for n in names if n in ring or reach[n] & set(ring)}

    @cache
    def level(n):
        return max((level(m) + 1 for m in needs[n]), default=0)

    return {n: (None if n in late else level(n), ring.get(n)) for n in names}


def told(spark, rows):
    return order.order(spark.createDataFrame(rows, "plan string, name string, needs string"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_small_plans(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(24)]
    rows, want = [], {}
    for plan in ("p", "q", None):
        edges = [(rng.choice(names), rng.choice(names)) for _ in range(14 + 6 * seed)] + [("n00", "elsewhere"), ("n01", "n01"), ("n02", None)]
        if plan == "q":  # no cycles
            edges = [(max(a, b), min(a, b)) if b and a != b else (a, b) for a, b in edges]
        rows += [(plan, a, b) for a, b in edges for _ in range(rng.choice([1, 2]))] + [(plan, n, None) for n in names]
        want |= {(plan, n): v for n, v in brute(edges, names).items()}
    got = {(r["plan"], r["name"]): (r["level"], r["component"]) for r in told(spark, rows).collect()}
    assert got == want
    places = {(r["plan"], r["name"]): r["place"] for r in order.placed(told(spark, rows), slices=5).collect()}
    for plan in ("p", "q", None):
        own = sorted((n for p, n in want if p == plan), key=lambda n: (want[plan, n][0] is None, want[plan, n][0] or 0, n))
        assert [places[plan, n] for n in own] == list(range(1, len(own) + 1))


def test_agrees_with_need_order_where_levels_decide(spark):
    rows = [("p", "c", None), ("p", "a", "b"), ("p", "b", "a")]
    placed = sorted((r["place"], r["name"]) for r in order.placed(told(spark, rows)).collect())
    assert [n for _, n in placed] == steps.by_need(["a", "b", "c"], {"a": {"b"}, "b": {"a"}, "c": set()}) == ["c", "a", "b"]
    chain = [(f"x{i:03}", {f"x{i - 1:03}"} if i else set()) for i in range(40)]
    placed = sorted((r["place"], r["name"]) for r in order.placed(told(spark, [("p", n, next(iter(d), None)) for n, d in chain])).collect())
    assert [n for _, n in placed] == steps.by_need([n for n, _ in chain], dict(chain))


def test_long_chains_need_few_rounds(spark, monkeypatch):
    """A chain of thousands, a ring of hundreds with a tail, and a star."""
    jobs, plain = [], order.settled
    monkeypatch.setattr(order, "settled", lambda df: jobs.append(1) or plain(df))
    rows = [("p", f"c{i}", f"c{i - 1}" if i else None) for i in range(3000)] + [("p", f"s{i}", "c2999") for i in range(500)]
    found = {r["name"]: (r["level"], r["component"]) for r in told(spark, rows).collect()}
    assert found["c2999"] == (2999, None) and found["s7"] == (3000, None) and len(found) == 3500 and len(jobs) < 40
    rows = [("p", f"r{i}", f"r{(i + 1) % 12}") for i in range(12)] + [("p", "t0", "r0"), ("p", "t1", "t0"), ("p", "z", None)]
    found = {r["name"]: (r["level"], r["component"]) for r in told(spark, rows).collect()}
    assert found["r5"] == (None, "r0") and found["t1"] == (None, None) and found["z"] == (0, None)
    assert told(spark, []).collect() == []


def test_sizes_do_not_multiply_over_rounds(spark, monkeypatch):
    """The estimate of a step's size, a whole number of any length on the driver, stays that of its rows."""
    bits, plain = [], order.settled

    def settled(df):
        kept = plain(df)
        bits.append(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return kept

    monkeypatch.setattr(order, "settled", settled)
    told(spark, [("p", f"r{i}", f"r{(i + 1) % 3}") for i in range(3)] + [("p", "t0", "r0"), ("p", "t1", "t0"), ("p", "z", None)]).collect()
    assert len(bits) > 10 and max(bits) < 40


def test_objects_that_met_their_root_are_not_asked_again(spark, monkeypatch):
    """A ring keeps the jumps going; the many beside it that stand on the ground are written a few times, not once a jump."""
    rows, plain = [], order.settled

    def settled(df):
        kept = plain(df)
        rows.append(kept.count())
        return kept

    monkeypatch.setattr(order, "settled", settled)
    wide = [("p", "g", None)] + [("p", f"a{i}", "g") for i in range(600)] + [("p", f"r{i}", f"r{(i + 1) % 12}") for i in range(12)]
    found = {r["name"]: (r["level"], r["component"]) for r in told(spark, wide).collect()}
    assert found == {"g": (0, None)} | {f"a{i}": (1, None) for i in range(600)} | {f"r{i}": (None, "r0") for i in range(12)}
    assert sum(n > 500 for n in rows) < 8


def test_cycles_through_trees(spark):
    """An object with two needs, on a cycle by one of them and over the ground by the other; a long tail and a short ring."""
    edges = [("d", "g"), ("d", "h"), ("d", "e"), ("e", "f"), ("f", "d"), ("over", "e"), ("two", "h"), ("two", "g"), ("h", "g"), ("up", "two"), ("mix", "up"), ("mix", "r0"), ("r0", "r1"), ("r1", "r0")]
    edges += [(f"t{i:02}", f"t{i - 1:02}" if i else "r1") for i in range(21)]
    names = sorted({n for e in edges for n in e})
    got = {r["name"]: (r["level"], r["component"]) for r in told(spark, [("p", a, b) for a, b in edges] + [("p", "g", None)]).collect()}
    assert got == brute(edges, names)


def test_numbers_that_two_names_share(spark, monkeypatch):
    """Another seed is taken if two objects share a number; a need outside the plan isn't the object whose number it has."""
    seeds, plain = [], order.number

    def number(plan, name, seed):
        seeds.append(seed)
        own = F.when(name == "ghost", plain(plan, F.lit("a"), seed)).otherwise(plain(plan, name, seed))
        return F.length(name).cast("long") if seed == 0 else own

    monkeypatch.setattr(order, "number", number)
    rows = [("p", "a", None), ("p", "b", "a"), ("p", "c", "ghost"), ("p", "d", "b")]
    assert {r["name"]: r["level"] for r in told(spark, rows).collect()} == {"a": 0, "b": 1, "c": 0, "d": 2} and set(seeds) == {0, 1}
    monkeypatch.setattr(order, "number", lambda plan, name, seed: F.length(name).cast("long"))
    with pytest.raises(RuntimeError):
        told(spark, rows)


def test_steps_are_taken_away(spark):
    kept = order.placed(told(spark, [("p", "a", "b"), ("p", "b", None)]))
    assert {r["name"]: r["place"] for r in kept.collect()} == {"b": 1, "a": 2}
    assert not [p for p in Path(shared(spark).removeprefix("file:")).iterdir() if p.name.startswith("order-")]
