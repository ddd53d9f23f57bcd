import pytest
from pyspark.sql import functions as F

from catalpa.functions import sqltypes
from catalpa.operators import batches, integrity, ledger
from catalpa.plans import changes, samples, steps, vocabulary
from catalpa.sources import snapshots
from catalpa.streaming import drift


def test_no_difference_with_itself(spark):
    """diff(x, x) is empty for every kind of object."""
    live = {n: getattr(samples, f"LIVE_{n}").frame(spark) for n in ("COLUMNS", "OBJECTS", "ENUMS", "VIEWS", "POLICIES", "GRANTS")}
    none = samples.RENAMES.frame(spark).where("false")
    every = F.lit(True)
    assert changes.table_changes(live["COLUMNS"], live["COLUMNS"], every).count() == 0
    assert changes.column_changes(live["COLUMNS"], live["COLUMNS"], none, every).count() == 0
    # An index that isn't valid and a constraint that isn't validated are still to be mended.
    assert {r["name"] for r in changes.object_changes(live["OBJECTS"], live["OBJECTS"]).collect()} == {"ix_broken", "fk_later"}
    assert changes.enum_changes(live["ENUMS"], live["ENUMS"], none).count() == 0
    assert changes.view_changes(live["VIEWS"], live["VIEWS"]).count() == 0
    assert changes.policy_changes(live["POLICIES"], live["POLICIES"]).count() == 0
    assert changes.grant_changes(live["GRANTS"], live["GRANTS"]).count() == 0


def test_foreign_keys_with_nulls(spark):
    child = spark.createDataFrame([(1, 10), (2, None), (3, 99), (4, 99)], "id int, ref int")
    parent = spark.createDataFrame([(10,), (10,), (None,)], "id int")
    assert [tuple(r) for r in integrity.foreign_key_report("c", child, parent, "ref", "id").collect()] == [("c", 4, 1, 2)]
    assert sorted(r["id"] for r in integrity.foreign_key_orphans(child, parent.toDF("p"), ["ref"], ["p"]).collect()) == [3, 4]
    assert [tuple(r) for r in integrity.foreign_key_report("c", child.where("false"), parent, "ref", "id").collect()] == [("c", 0, 0, 0)]


def test_keyset_pages_cover_all_rows(spark):
    rows = [(a, b) for a in range(5) for b in range(7)]
    df, seen, cursor = spark.createDataFrame(rows, "a int, b int"), [], None
    while page := [tuple(r) for r in batches.keyset_page(df, ["a", "b"], cursor, 8).collect()]:
        seen += page
        cursor = page[-1]
    assert seen == rows


def test_chunks_of_ties_and_nothing(spark):
    df = spark.createDataFrame([(i // 10,) for i in range(95)], "k long")
    out = sorted(tuple(r) for r in batches.chunk_bounds(df, "k", 20, slices=4).collect())
    assert [r[3] for r in out] == [20, 20, 20, 20, 15] and out[0][1:3] == (0, 1)
    assert batches.chunk_bounds(df.where("false"), "k", 20).count() == 0


def test_seeds_are_idempotent(spark):
    target = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "id int, name string, n int")
    seed = spark.createDataFrame([(2, "b", 7), (3, "c", 8)], "id int, name string, n int")
    once = batches.seed_upsert(target, seed, ["id"], ["name"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 5), (2, "b", 6), (3, "c", 8)]
    assert sorted(map(tuple, batches.seed_upsert(once, seed, ["id"], ["name"]).collect())) == sorted(map(tuple, once.collect()))
    kept = batches.seed_ignore(target, seed, ["id"])
    assert sorted(map(tuple, batches.seed_ignore(kept, seed, ["id"]).collect())) == sorted(map(tuple, kept.collect())) == [(1, "a", 5), (2, None, 6), (3, "c", 8)]


def test_ledger_readiness_after_repair(spark):
    rows = [(1, "a", "applied", "h1", None), (2, "a", "failed", "h2", "boom"), (3, "b", "applied", "h3", None)]
    log = spark.createDataFrame(rows, "id long, schema_name string, status string, schema_hash string, error string")
    wanted = spark.createDataFrame([("a", "h2"), ("b", "h3"), ("c", "h4")], "schema_name string, schema_hash string")
    assert {r["schema_name"]: r["is_ready"] for r in ledger.ready(log, wanted).collect()} == {"a": False, "b": True, "c": False}
    mended = ledger.repaired(log, "!")
    assert mended.where("id = 2").select("status", "error").first() == ("resolved", "boom!")
    assert ledger.status_counts(mended).first()["applied"] == 3 and not ledger.ready(mended, wanted).where("schema_name = 'a'").first()["is_ready"]


def test_every_change_type_has_a_place_and_a_bucket():
    assert len(vocabulary.CHANGE_TYPES) == 71 and len(vocabulary.PRIORITY) == 70
    assert vocabulary.bucket("DROP_DOMAIN_RETYPE") == "deletion" and vocabulary.bucket("DROP_RANGE_RETYPE") is None
    assert vocabulary.bucket("REVOKE") == "modification" and vocabulary.bucket("COMMENT_TABLE") is None


@pytest.mark.parametrize(("glob", "yes", "no"), [("a*", "abc", "ba"), ("a?c", "abc", "ac"), ("[a-c]x", "bx", "dx"), (r"a\*", "a*", "ab"), ("w[", "w[", "w"), ("*", "x", "a/b")])
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(yes,), (no,)], "n string")
    assert [r["n"] for r in df.where(sqltypes.matches_glob(F.col("n"), glob)).collect()] == [yes]


def test_strict_scope():
    with pytest.raises(ValueError, match="strict"):
        sqltypes.is_managed(F.lit("x"), strict=True)


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(30)], "node string, needs string")
    out = steps.closure(edges)
    assert out.count() == 30 * 31 // 2 and out.where("node = 'n0' AND needs = 'n30'").first()["depth"] == 30


def test_plan_documents_round_trip(spark, tmp_path):
    rows = samples.STEPS.frame(spark).select(F.lit("p").alias("plan_id"), "idx", "change_type", "tbl", "sql_text", "destructive", "non_tx")
    document = snapshots.plan_documents(rows).first()["document"]
    (tmp_path / "p.json").write_text(document)
    (tmp_path / "broken.json").write_text("{")
    back = snapshots.plan_steps(spark, str(tmp_path))
    assert back.orderBy("idx").select("change_type").collect() == rows.orderBy("idx").select("change_type").collect()


def test_ledger_is_appended(spark, tmp_path):
    one = spark.createDataFrame([(1, "applied")], "id long, status string")
    for _ in range(2):
        snapshots.append_records(one, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2


def test_drift_stream(spark, tmp_path):
    live = samples.LIVE_COLUMNS.frame(spark)
    live.write.parquet(str(tmp_path / "live"))
    stream = spark.readStream.schema(live.schema).parquet(str(tmp_path / "live"))
    query = drift.watch_columns(stream, samples.DESIRED_COLUMNS.frame(spark), samples.RENAMES.frame(spark), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
