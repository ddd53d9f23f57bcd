"""Resumable backfill, routing by bounds and comparison by digests, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalpa.operators import digests, intervals, resumable
from catalpa.operators.batches import chunk_bounds, row_level_diff
from catalpa.session import exists, new_folder, remove

SCHEMA = "a int, b string, new int, old int"
KEY = ["a", "b"]


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(n // 3 + 1), rng.choice("xyz"), rng.choice([None, 5]), rng.choice([None, 7, 8])) for _ in range(n)]


def filled(rows):
    return Counter((a, b, old if new is None else new, old) for a, b, new, old in rows)


def outcome(spark, folder, df):
    return Counter(tuple(r) for r in resumable.result(spark, folder, df.schema).collect())


def test_killed_between_chunk_and_commit(spark):
    rows = [*rows_of(300), (None, "x", None, 1), (3, None, None, 2), (None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    folder = new_folder(spark, "test")
    resumable.plan(df, KEY, 40, folder)
    assert resumable.plan(df, KEY, 10, folder).count() == 8  # planned once
    work = (df, KEY, "new", "old", folder)
    assert resumable.run(*work, most=3) == 3
    assert resumable.write(*work, most=2)  # killed here
    first = resumable.progress(spark, folder).first()
    assert (first["chunks"], first["committed"]) == (8, 3) and first["cursor"] is not None
    assert not outcome(spark, folder, df) - filled(rows)
    assert resumable.run(*work) == 5 and resumable.run(*work) == 0
    assert outcome(spark, folder, df) == filled(rows)
    last = resumable.progress(spark, folder).first()
    assert (last["committed"], last["rows"], last["cursor"]) == (8, len(rows), None)
    remove(spark, folder)
    assert not exists(spark, folder)


def test_doubled_runs_repeat_nothing(spark):
    rows = rows_of(120, seed=2)
    df = spark.createDataFrame(rows, SCHEMA)
    folder = new_folder(spark, "test")
    resumable.plan(df, KEY, 25, folder)
    work = (df, KEY, "new", "old", folder)
    two = [resumable.write(*work), resumable.write(*work, most=2)]
    for attempt in [*two, two[0]]:  # one of them commits twice
        resumable.commit(spark, folder, attempt, KEY, df.schema)
    assert resumable.commits(spark, folder).count() == 12 and resumable.finished(spark, folder).count() == 5
    assert outcome(spark, folder, df) == filled(rows)


def test_rows_that_come_late_and_edges(spark):
    df = spark.createDataFrame([(k, "x", None, k) for k in range(1, 50)], SCHEMA)
    folder = new_folder(spark, "test")
    resumable.plan(df, KEY, 10, folder)
    resumable.run(df, KEY, "new", "old", folder, most=1)
    more = df.unionByName(spark.createDataFrame([(1000, "x", None, 3), (30, "zz", None, 4)], SCHEMA)).where("a NOT BETWEEN 11 AND 20")
    while resumable.run(more, KEY, "new", "old", folder, most=2):
        pass
    assert {r[0] for r in outcome(spark, folder, df)} == {*range(1, 11), *range(21, 50), 1000}
    for rows in ([], [(1, "x", None, 9)] * 30):  # no rows, and one key
        some, at = spark.createDataFrame(rows, SCHEMA), new_folder(spark, "test")
        resumable.plan(some, ["a"], 7, at)
        while resumable.run(some, ["a"], "new", "old", at, most=1):
            pass
        assert outcome(spark, at, some) == filled(rows)


def brute_route(value, bounds):
    return sorted(p for p, low, high in bounds if value is not None and (low is None or value >= low) and (high is None or value < high)) or [None]


@pytest.mark.parametrize("buckets", [2, 7, 256])
def test_routing(spark, monkeypatch, buckets):
    monkeypatch.setattr(intervals, "BUCKETS", buckets)
    rng = random.Random(buckets)
    cuts = sorted(rng.sample(range(1000), 60))
    bounds = [(f"p{i}", a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if i % 5] + [("first", None, cuts[0]), ("last", cuts[-1] + 3, None), ("void", 500, 500), ("over", 100, 400)]
    values = [None, -5, 0, 999, 5000, *cuts, *[rng.randrange(1000) for _ in range(200)]]
    df = spark.createDataFrame(list(enumerate(values)), "n int, v int")
    got = intervals.route(df, F.col("v"), spark.createDataFrame(bounds, "part string, low long, high long"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((n, v, p) for n, v in enumerate(values) for p in brute_route(v, bounds)), key=repr)


def test_routing_plan_does_not_grow(spark):
    """Ten thousand partitions give the plan that a hundred give, but for the numbers in it."""
    plans = []
    for n in (400, 10000):
        bounds = spark.range(n).selectExpr("concat('p', id) AS part", "id * 3 AS low", "id * 3 + 3 AS high")
        routed = intervals.route(spark.range(3 * n), F.col("id"), bounds)
        assert routed.groupBy("part").count().where("count = 3").count() == n
        plans.append(routed._jdf.queryExecution().optimizedPlan().toString())
    assert len(plans[1]) < 1.5 * len(plans[0]) and "BroadcastHashJoin" in routed._jdf.queryExecution().executedPlan().toString()


def brute_sweep(bounds):
    over, gaps = set(), set()
    low, high = (lambda x: float("-inf") if x is None else x), (lambda x: float("inf") if x is None else x)
    for parent in {b[0] for b in bounds}:
        own = sorted((low(a), p, high(b)) for q, p, a, b in bounds if q == parent and low(a) < high(b))
        for i, (a, p, _) in enumerate(own):
            before = max(((h, q) for _, q, h in own[:i]), default=None)
            if before and a < before[0]:
                over.add((parent, p, before[1]))
            if before and a > before[0]:
                gaps.add((parent, before[0], a))
    return over, gaps


def test_sweep(spark):
    rng = random.Random(4)
    starts = [(f"t{rng.randrange(3)}", f"p{i:03}", rng.randrange(400)) for i in range(150)]
    bounds = [(t, p, None if rng.random() < 0.02 else low, None if rng.random() < 0.01 else low + rng.randrange(-1, 6)) for t, p, low in starts]
    df = spark.createDataFrame(bounds, "parent string, part string, low int, high int")
    over, gaps = brute_sweep(bounds)
    assert over and gaps
    assert {tuple(r) for r in intervals.overlaps(df).collect()} == over and {tuple(r) for r in intervals.gaps(df).collect()} == gaps
    assert intervals.overlaps(df.where("false")).collect() == []


def test_hash_partitions(spark):
    parts = [("t", "a", 2, 0), ("t", "b", 4, 1), ("t", "c", 8, 3), ("t", "d", 8, 1), ("t", "odd", 3, 1)]
    df = spark.createDataFrame(parts, "parent string, part string, modulus int, remainder int")
    got = {r["claim"]: r["parts"] for r in intervals.misclaimed(df).collect()}
    assert got == {1: 2, 7: 0}
    routed = intervals.route_hash(spark.range(16), F.col("id"), df).collect()
    want = [(i, p) for i in range(16) for p in ([n for _, n, m, r in parts if n != "odd" and i % m == r] or [None])]
    assert sorted(map(tuple, routed), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_digests_agree_with_full_diff(spark, kind):
    rng = random.Random(7)
    live = [(k, k % 3, rng.choice([None, "s", "t"]), rng.choice([None, 1.5])) for k in range(2000)]
    desired = [(k, p, s if k % 97 else "new", f if k % 131 else None) for k, p, s, f in live if k % 301] + [(5000 + k, 0, None, None) for k in range(4)]
    schema = f"k {kind}, p int, s string, f double"
    text = (lambda rows: [(str(r[0]), *r[1:]) for r in rows]) if kind == "string" else (lambda rows: rows)
    a, b = (spark.createDataFrame(text(rows), schema) for rows in (live, desired))
    args = (a, b, ["k", "p"], ["s", "f"])
    want = sorted(map(tuple, row_level_diff(*args).collect()))
    assert want and sorted(map(tuple, digests.digest_diff(*args, rows=50, split=16).collect())) == want
    met = sum(side.count() for side in digests.suspects(*args, rows=50, split=16))
    assert met < 800  # of about 4,000
    assert digests.digest_diff(a, a, ["k", "p"], ["s", "f"]).collect() == []
    empty = a.where("false")
    assert digests.digest_diff(empty, a, ["k", "p"], ["s"]).where("change = 'added'").count() == 2000 and digests.digest_diff(empty, empty, ["k", "p"], ["s"]).collect() == []


def test_a_chunk_is_written_by_several_tasks(spark):
    df = spark.range(400).selectExpr("id AS a", "'x' AS b", "cast(null AS int) AS new", "1 AS old")
    folder, setting = new_folder(spark, "test"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # else four hundred rows come to one task
    try:
        resumable.plan(df, KEY, 200, folder)
        attempt = resumable.write(df, KEY, "new", "old", folder, most=1)
    finally:
        spark.conf.unset(setting)
    files = spark.read.parquet(f"{folder}/data/attempt={attempt}").select("chunk", F.input_file_name().alias("file")).distinct().groupBy("chunk").count().collect()
    assert [(r["chunk"], r["count"] > 1) for r in files] == [(1, True)]
    resumable.commit(spark, folder, attempt, KEY, df.schema)
    assert resumable.finished(spark, folder).select("chunk", "rows").collect() == [(1, 200)]


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_chunk_bounds_group_the_ends_only(spark, size):
    """Against plain Python, with repeated and null keys, of one column and of two."""
    rng = random.Random(size)
    keys = [(rng.choice([None, rng.randrange(30)]), rng.choice([None, "x", "y"])) for _ in range(150)]
    df = spark.createDataFrame(keys, "a int, b string")
    low = lambda k: tuple((x is not None, x) for x in k)
    for key, rows in (("a", sorted([k[:1] for k in keys], key=low)), (["a", "b"], sorted(keys, key=low))):
        found = chunk_bounds(df, key, size, slices=5)
        assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()
        want = []
        for i in range(0, len(rows), size):
            chunk = rows[i : i + size]
            told = [k[0] for k in chunk if k[0] is not None] if key == "a" else chunk
            want.append((i // size + 1, told[0] if told else None, told[-1] if told else None, len(chunk)))
        bare = lambda x: tuple(x) if isinstance(x, tuple) else x
        assert [(r[0], bare(r[1]), bare(r[2]), r[3]) for r in found.orderBy("chunk").collect()] == want
