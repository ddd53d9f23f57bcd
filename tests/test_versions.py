"""Checked swaps: failing and passing runs, racing ones, and what readers see."""

import pytest

from catalpa.operators import versions
from catalpa.session import exists, new_folder


@pytest.fixture
def made(spark):
    folder = new_folder(spark, "test")
    versions.create(spark.createDataFrame([(k, k % 7 * 10, None if k % 5 == 0 else "x") for k in range(100)], "k long, val int, tag string"), folder)
    return folder


def seen(spark, folder):
    return sorted(map(tuple, versions.current(spark, folder).collect()))


def test_a_good_rebuild_is_swapped_in(spark, made):
    old = versions.current(spark, made)
    assert versions.swap(made, old.drop("tag").repartition(3), {"k": "k", "val": "val"}) == 2
    assert versions.current(spark, made).columns == ["k", "val"] and seen(spark, made) == [(k, k % 7 * 10) for k in range(100)]
    wide = versions.current(spark, made).selectExpr("k", "cast(val AS long) * 2 AS twice")
    assert versions.swap(made, wide, {"k": "k", "twice": "val * 2"}) == 3
    assert [r["rows"] for r in versions.history(spark, made).collect()] == [100, 100, 100]


@pytest.mark.parametrize("fault", ["k < 99", "k >= 0 UNION ALL SELECT 1, 10", "k <> 1 UNION ALL SELECT 1, 11", "k <> 5 UNION ALL SELECT 5, NULL"])
def test_a_bad_rebuild_changes_nothing(spark, made, fault):
    before = seen(spark, made)
    rows = spark.sql(f"SELECT k, val FROM {{t}} WHERE {fault}", t=versions.current(spark, made))
    with pytest.raises(versions.SwapRefused):
        versions.swap(made, rows, {"k": "k", "val": "val"})
    assert seen(spark, made) == before and versions.history(spark, made).count() == 1


def test_nulls_refuse_a_column(spark, made):
    with pytest.raises(versions.SwapRefused, match="nulls 20"):
        versions.swap(made, versions.current(spark, made), {"k": "k", "tag": "tag"}, never_null=("tag",))


def test_the_first_of_two_swaps_counts(spark, made):
    old = versions.current(spark, made)
    versions.swap(made, old.drop("tag"), {"k": "k", "val": "val"})
    name = versions.history(spark, made).where("version = 2").first()["name"]
    with pytest.raises(versions.SwapRefused, match="first"):
        versions.point_to(spark, made, 2, "late", 100, ["k"])
    assert versions.history(spark, made).where("version = 2").first()["name"] == name and versions.current(spark, made).columns == ["k", "val"]


def test_old_versions_are_taken_away(spark, made):
    for _ in range(3):
        versions.swap(made, versions.current(spark, made), {"k": "k"})
    gone = versions.unused(spark, made, keep=2)
    assert len(gone) == 2 and versions.forget(spark, made, keep=2) == 2 and versions.forget(spark, made, keep=2) == 0
    assert not exists(spark, f"{made}/versions/{gone[0]}") and len(seen(spark, made)) == 100


def test_an_empty_table(spark):
    folder = new_folder(spark, "test")
    with pytest.raises(LookupError):
        versions.current(spark, folder)
    versions.create(spark.createDataFrame([], "k long, a string"), folder)
    assert versions.swap(folder, versions.current(spark, folder).drop("a"), {"k": "k"}) == 2 and seen(spark, folder) == []
    with pytest.raises(versions.SwapRefused):
        versions.swap(folder, spark.createDataFrame([(1,)], "k long"), {"k": "k"})
