"""Mergeable metrics: merged equals one pass, quantiles within their error, repeated batches count once."""

import datetime
import random

from catalpa.operators import metrics
from catalpa.session import new_folder

SCHEMA = "schema_name string, day date, status string, duration_ms long, plan_hash string"


def records(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), datetime.date(2024, 1, 1 + rng.randrange(4)), rng.choice(["applied", "failed"]), rng.choice([None, 0, -5, 1, int(10 ** (9 * rng.random()))]), rng.choice([None, f"h{rng.randrange(300)}"])) for _ in range(n)]


def test_merge_equals_one_pass(spark):
    rows, folder = records(3000), new_folder(spark, "test")
    df = spark.createDataFrame(rows, SCHEMA)
    for n in range(3):
        assert metrics.append(spark.createDataFrame(rows[n::3], SCHEMA), folder, str(n))
    assert not metrics.append(df, folder, "1")
    for by in (["schema_name"], ["day", "status"], []):
        got = metrics.quantiles(metrics.durations(spark, folder), by, (1, 50, 99))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, metrics.quantiles(metrics.buckets(df), by, (1, 50, 99)).collect()))
    plans = {r["schema_name"]: r["plans"] for r in metrics.plan_counts(metrics.plans(spark, folder), ["schema_name"]).collect()}
    assert plans == {s: len({r[4] for r in rows if r[0] == s and r[4]}) for s in ("a", "b", None)}


def test_quantiles_are_within_the_error(spark):
    rows = records(2000, seed=2)
    got = {r["schema_name"]: r for r in metrics.quantiles(metrics.buckets(spark.createDataFrame(rows, SCHEMA)), ["schema_name"], (1, 25, 50, 90, 100)).collect()}
    for s in ("a", "b", None):
        own = sorted(max(0, r[3]) for r in rows if r[0] == s and r[3] is not None)
        assert got[s]["records"] == len(own) and got[s]["total"] == sum(own)
        for p in (1, 25, 50, 90, 100):
            exact = own[-(-len(own) * p // 100) - 1]
            assert abs(got[s][f"p{p}"] - exact) <= (metrics.ERROR + 1e-9) * exact


def test_a_broken_batch_is_written_again(spark):
    rows, folder = records(200, seed=3), new_folder(spark, "test")
    df = spark.createDataFrame(rows, SCHEMA)
    metrics.buckets(df).write.parquet(f"{folder}/durations/batch=x")  # the run broke before the plans
    assert metrics.append(df, folder, "x") and not metrics.append(df, folder, "x")
    assert metrics.quantiles(metrics.durations(spark, folder), [], (50,)).first()["records"] == sum(r[3] is not None for r in rows)
    assert metrics.durations(spark, new_folder(spark, "none")).count() == 0


def test_many_plans_are_told_about(spark):
    df = spark.range(60000).selectExpr("'a' AS schema_name", "date '2024-01-01' AS day", "'applied' AS status", "id AS duration_ms", "md5(cast(id AS string)) AS plan_hash")
    told = metrics.plan_counts(metrics.plan_sketches(df), ["schema_name"]).first()["plans"]
    assert abs(told - 60000) < 4 * 60000 / 2 ** (metrics.LOG_NOMINAL / 2)
