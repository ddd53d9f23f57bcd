import datetime

import pytest
from pyspark.sql import functions as F

from catalpa.functions import sqltypes
from catalpa.operators import integrity, ledger, lint
from catalpa.plans import catalog, catalog_queries, changes, generated, guards, steps, vocabulary
from catalpa.sources import snapshots
from catalpa.streaming import drift

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


def test_made_up_checks_need_a_live_column(spark):
    names = ["user_check", "users_check", "user_positive_check", "user_age_check2", "user_age_chk", "other_check"]
    live = spark.createDataFrame([("check", "user", n, "x > 0", True) for n in names], "kind string, tbl string, name string, definition string, valid boolean")
    columns = spark.createDataFrame([("user", "age"), ("users", "positive")], "tbl string, col string")
    dropped = {r["name"] for r in changes.object_changes(live, live.where("false"), columns).collect()}
    assert dropped == {"users_check", "user_positive_check", "user_age_chk", "other_check"}


def test_enum_renames(spark):
    """By `<enum>.<label>`, then `enum.<enum>.<label>`; one label a target, the first by position; each schema has its own enums."""
    live = spark.createDataFrame([("s", "mood", "sad", 1), ("s", "mood", "ok", 2), ("s", "mood", "low", 3), ("s", "mood", "stays", 4), ("t", "mood", "ok", 1)], "sch string, name string, label string, pos int")
    desired = spark.createDataFrame([("s", "mood", "blue", 1), ("s", "mood", "fine", 2), ("s", "mood", "stays", 3), ("t", "mood", "new", 1)], "sch string, name string, label string, pos int")
    renames = spark.createDataFrame([("mood.sad", "blue"), ("mood.low", "blue"), ("mood.stays", "blue"), ("enum.mood.ok", "fine"), ("enum.sad", "fine")], "old_name string, new_name string")
    got = {(r["sch"], r["label"], r["new_label"], r["change_type"]) for r in changes.enum_changes(live, desired, renames).collect()}
    assert got == {("s", "sad", "blue", "RENAME_ENUM_VALUE"), ("s", "ok", "fine", "RENAME_ENUM_VALUE"), ("s", "low", None, "DROP_ENUM_VALUE"), ("t", "ok", None, "DROP_ENUM_VALUE"), ("t", "new", None, "ALTER_ENUM")}


def test_one_rename_a_target_and_attached_partitions(spark):
    """Of columns mapped to one new name the first is renamed; repeated mappings count once; an attached partition's columns are its parent's."""
    schema = "sch string, tbl string, col string, data_type string, nullable boolean, dflt string, generated string"
    col = lambda sch, tbl, name, nullable=True: (sch, tbl, name, "int", nullable, "", "")
    live = spark.createDataFrame([col(s, "t", c) for s in "ab" for c in "bcd"] + [col("a", "part", "x")], schema)
    desired = spark.createDataFrame([col(s, "t", "n", False) for s in "ab"] + [col("b", "t", "d")] + [col("a", "part", "y")], schema)
    renames = spark.createDataFrame([("t.c", "n"), ("t.c", "o"), ("b", "n"), ("d", "n")], "old_name string, new_name string")
    partitions = spark.createDataFrame([("a", "part")], "sch string, tbl string")
    found = changes.column_changes(live, desired, renames, F.lit(True), partitions=partitions).collect()
    assert {(r["sch"], r["col"], r["new_col"], r["change_type"]) for r in found} == {("a", "b", "n", "RENAME_COLUMN"), ("a", "c", None, "DROP_COLUMN"), ("a", "d", None, "DROP_COLUMN"), ("b", "b", "n", "RENAME_COLUMN"), ("b", "c", None, "DROP_COLUMN")}
    grown = changes.column_changes(live, desired, renames, F.lit(True), expand=True, partitions=partitions).where("change_type = 'ADD_COLUMN'").collect()
    assert {(r["sch"], r["col"], r["new_col"], r["not_null"]) for r in grown} == {("a", "n", "b", False), ("b", "n", "b", False)}


def test_columns_of_both_sides_meet_in_one_shuffle(spark):
    """By table, also with attached partitions; a mapping of a bare name holds for all tables."""
    schema = "sch string, tbl string, col string, data_type string, nullable boolean, dflt string, generated string"
    live = spark.createDataFrame([("s", "t", "a", "int", True, "", ""), ("s", "t", "b", "text", True, "'x'::text", ""), (None, "t", "b", "int", True, "", ""), ("s", "gone", "a", "int", True, "", "")], schema)
    desired = spark.createDataFrame([("s", "t", "c", "int4", True, "", ""), ("s", "t", "b", "varchar(5)", False, "'x'", ""), (None, "t", "b", "text", True, "", ""), ("s", "new", "a", "int", True, "", "")], schema)
    parts = spark.createDataFrame([("s", "part")], "sch string, tbl string")
    found = changes.differing(live, desired, ["sch", "tbl"], parts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert {(r["col"], r["side"], r["retyped"]) for r in found.collect()} == {("a", "live", True), ("b", "both", True), ("c", "desired", True)}
    renames = spark.createDataFrame([("a", "c"), ("other.a", "d")], "old_name string, new_name string")
    told = {(r["col"], r["new_col"], r["change_type"], r["destructive"], r["narrowed"]) for r in changes.column_changes(live, desired, renames, F.lit(True), partitions=parts).collect()}
    assert told == {("a", "c", "RENAME_COLUMN", False, False), ("b", None, "ALTER_COLUMN", True, True)}


def test_nulls_on_both_sides_are_no_difference(spark):
    view = spark.createDataFrame([("v", None, False, None)], "name string, definition string, materialised boolean, cols array<string>")
    assert changes.view_changes(view, view).count() == 0
    policy = spark.createDataFrame([("t", "p", None, None, ["x"], None, None)], "tbl string, name string, cmd string, permissive boolean, roles array<string>, using_expr string, check_expr string")
    assert changes.policy_changes(policy, policy).count() == 0
    wanted = spark.createDataFrame([("s", "t"), ("s", None), ("u", "t")], "sch string, tbl string")
    left = spark.createDataFrame([("s", "t"), ("s", "t"), ("s", None)], "sch string, tbl string")
    assert {tuple(r) for r in steps.drift(wanted, left, ["sch", "tbl"]).collect()} == {("s", "t", 2, True), ("s", None, 1, True), ("u", "t", 0, False)}


def test_reserved_words_and_duplicate_checks(spark):
    tables = spark.createDataFrame([("all",), ("fine",)], "tbl string")
    columns = spark.createDataFrame([("fine", "Values"), ("fine", "value")], "tbl string, col string")
    assert rows(lint.reserved({"tables": tables, "columns": columns}).select("tbl", "item")) == [("all", ""), ("fine", "Values")]
    same = [("CHECK ((a > 0))", "a>0"), ("((a > 0))", "a>0"), ("(a > 0) AND (b > 0)", "(a>0)and(b>0)"), ("check (name <> 'A ) b')", "name<>'A ) b'"), ("fn(a)", "a"), ("", ""), ("(" * 12 + "a > 0" + ")" * 12, "a>0")]
    for raw, folded in same:
        assert one(spark, raw, lint.folded_check) == folded
    assert set(lint.profile("STANDARD", ("l006",))) == set(lint.STANDARD) - {"L006"}
    with pytest.raises(ValueError, match="profile"):
        lint.profile("none")


@pytest.mark.parametrize(
    ("definition", "name"),
    [("CREATE TRIGGER t EXECUTE FUNCTION public.touch()", "touch"), ('x execute procedure "S"."Touch It"(1)', "Touch It"), ("x EXECUTE FUNCTION Touch()", "touch"), ("nothing", "")],
)
def test_trigger_functions(spark, definition, name):
    assert one(spark, definition, sqltypes.trigger_function) == name


def test_order_by_need():
    assert steps.by_need(["a", "b", "c", "d"], {"a": {"c"}, "b": set(), "c": set(), "d": {"a"}}) == ["b", "c", "a", "d"]
    assert steps.by_need(["a", "b", "c"], {"a": {"b"}, "b": {"a"}, "c": set()}) == ["c", "a", "b"]
    chain = [f"t{i:03}" for i in range(100)]
    assert steps.by_need(sorted(chain), {n: {chain[i + 1]} if i < 99 else set() for i, n in enumerate(chain)}) == chain[::-1]


def test_every_hazard_can_be_told(spark):
    """Each conditional hazard fires on some derived step, and each change type with a hazard of its own tells it."""
    told = steps.hazards(generated.frame(spark, SF, "steps")).groupBy("code").count()
    codes = {r["code"] for r in told.collect()}
    assert codes == {c for c, _, _ in steps.HAZARDS if c} | {c for c, _ in vocabulary.HAZARD_OF_TYPE.values()}
    assert set(vocabulary.REMEDIES) <= codes


def test_nothing_differs_from_itself(spark):
    live = {n: generated.frame(spark, SF, f"live_{n}") for n in ("columns", "types", "routines", "domains", "tables", "extensions")}
    empty = [
        catalog.extension_changes(live["extensions"], live["extensions"]),
        catalog.range_changes(*[live["types"].where("kind = 'range'").select("name", "data_type")] * 2),
        catalog.composite_changes(*[live["types"].where("kind = 'composite'").drop("kind")] * 2),
        catalog.routine_changes(live["routines"], live["routines"]),
        catalog.domain_changes(*[live["domains"].select("name", "base", "nullable", "dflt")] * 2),
        catalog.rls_changes(*[live["tables"].select("sch", "tbl", "rls", "forced")] * 2),
        catalog.refused_conversions(live["tables"], live["tables"]),
        changes.column_changes(live["columns"], live["columns"], generated.frame(spark, SF, "renames").where("false"), F.lit(True)),
    ]
    assert [df.count() for df in empty] == [0] * len(empty)
    # A detach that was cut off is still to be ended, whatever is wanted.
    pending = live["tables"].where("parent <> '' AND pending")
    assert catalog.partition_changes(live["tables"], live["tables"]).count() == pending.count()


def test_grants_to_pass_on_and_all(spark):
    kinds = "kind string, obj string, grantee string, privileges array<string>, grantable boolean"
    live = spark.createDataFrame([("sequence", "s", "app", ["USAGE", "SELECT", "UPDATE"], False), ("table", "t", "app", ["SELECT"], False)], kinds)
    desired = spark.createDataFrame([("sequence", "s", "app", ["all"], False), ("table", "t", "app", ["SELECT"], True)], kinds)
    assert rows(changes.grant_changes(live, desired)) == [("table", "t", "app", "GRANT", "SELECT")]


def test_replay_of_operations(spark):
    ops = [(1, "a", "CREATE", "x", ""), (2, "a", "ALTER", "y", "n"), (3, "b", "CREATE", "x", ""), (4, "b", "DROP", "", ""), (5, "c", "ALTER", "z", ""), (6, "a", "DROP", "", ""), (7, "a", "CREATE", "", "")]
    assert rows(catalog.replayed(spark.createDataFrame(ops, "seq long, role string, op string, attrs string, remark string"))) == [("a", "", "")]


def test_many_foreign_keys_in_one_join(spark):
    child = spark.createDataFrame([(1, 10), (2, None), (None, 99)], "a int, b long")
    parent = spark.createDataFrame([(1,), (10,), (10,)], "p int")
    out = integrity.foreign_key_reports([("child", child, [("fa", "a", parent, "p"), ("fb", "b", parent, "p")]), ("none", child.where("false"), [("fc", "a", parent, "p")])])
    assert rows(out) == [("fa", 3, 1, 1), ("fb", 3, 1, 1), ("fc", 0, 0, 0)]


def test_baselines_go_on_after_the_last_id(spark):
    log = spark.createDataFrame([(4, "a", "h", "applied", None, "s")], "id long, schema_name string, plan_hash string, status string, error string, schema_hash string")
    wanted = spark.createDataFrame([("a", "x", "y"), ("c", "x", "y"), ("b", "x", "y")], "schema_name string, plan_hash string, schema_hash string")
    out = ledger.with_baseline(log, wanted, "note")
    assert rows(out.select("id", "schema_name", "status")) == [(4, "a", "applied"), (5, "b", "baseline"), (6, "c", "baseline")]
    assert ledger.with_baseline(log.where("false"), wanted, "note").agg(F.max("id")).first()[0] == 3
    assert ledger.ready(out, wanted).where("is_ready").count() == 2


def test_broken_documents_are_told(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"hash": "h", "steps": [{"change_type": "DROP_TABLE", "tbl": "t"}]}')
    (tmp_path / "bad.json").write_text("{")
    assert [r["file"].rpartition("/")[2] for r in snapshots.broken_plans(spark, str(tmp_path)).collect()] == ["bad.json"]


def test_drift_keeps_what_came_before(spark, tmp_path):
    """A table's columns may come in several batches; after the second nothing is told as missing that came in the first."""
    kinds = "tbl string, col string, data_type string, nullable boolean, dflt string, generated string"
    desired = spark.createDataFrame([("t", "a", "int", True, "", ""), ("t", "b", "int", True, "", "")], kinds)
    renames = spark.createDataFrame([], "old_name string, new_name string")
    left = []
    for n, row in enumerate([("t", "a", "int", True, "", ""), ("t", "b", "text", True, "", "")]):
        spark.createDataFrame([row], kinds).write.mode("append").parquet(str(tmp_path / "live"))
        stream = spark.readStream.schema(kinds).parquet(str(tmp_path / "live"))
        drift.watch_columns(stream, desired, renames, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
        left.append(rows(spark.read.parquet(str(tmp_path / "out" / f"batch={n}")).select("col", "change_type")))
    assert left == [[("b", "ADD_COLUMN")], [("b", "ALTER_COLUMN")]]


def test_windows_of_statuses(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10, 15)
    spark.createDataFrame([(at, "applied"), (at, "failed"), (at + datetime.timedelta(minutes=50), "applied"), (at + datetime.timedelta(hours=9), "applied")], "applied_at timestamp, status string").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("applied_at timestamp, status string").parquet(str(tmp_path / "log"))
    query = drift.status_windows(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("status = 'applied'").count() == 2 and out.agg(F.sum("records")).first()[0] == 3


def test_checkpoints_need_a_shared_folder():
    from catalpa import session

    class Frame:
        class sparkSession:  # noqa: N801
            class sparkContext:  # noqa: N801
                master = "spark://host:7077"
                getCheckpointDir = staticmethod(lambda: None)

            class conf:  # noqa: N801
                get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.checkpoint(Frame)


def test_roles_that_may_be_dropped(spark):
    roles = spark.createDataFrame([(i, f"r{i}") for i in range(9)], "id long, role string")
    owners = spark.createDataFrame([("schema", 1), ("large object", 1), ("type", None)], "catalog string, owner long")
    entries = [("relation", "a", "r", None, 2), ("relation", "z", "r", None, 3), ("relation", "a", "i", None, 4), ("function", "a", "p", None, 5), ("database", None, None, True, 6), ("database", None, None, False, 7), ("default access", "a", "r", None, 8), ("schema", "a", None, None, 2), ("function", "a", "f", None, 2), ("schema", None, None, None, 8)]
    entries = spark.createDataFrame(entries, "kind string, sch string, detail string, here boolean, grantee long")
    got = {r["role"]: (r["owned"], r["unhandled"], r["may_drop"]) for r in guards.role_guards(roles, owners, entries, ("a", "b")).collect()}
    assert {n for n, r in got.items() if r[2]} == {"r0", "r2", "r6"} and got["r1"] == (2, 0, False) and got["r8"] == (0, 2, False)
    assert guards.role_guards(roles, owners, entries, ()).where("may_drop").count() == 2


@pytest.mark.parametrize(("kind", "item", "version", "concurrent", "outside"), [("DETACH_PARTITION", "", 140000, True, True), ("DETACH_PARTITION", "", 139999, True, False), ("DETACH_PARTITION", "", 150000, False, False), ("DETACH_PARTITION", "default", 150000, True, False), ("DETACH_PARTITION", "pending", 150000, True, False), ("CREATE_INDEX", "", 90000, False, True), ("ADD_COLUMN", "", 150000, True, False)])
def test_steps_outside_transactions(spark, kind, item, version, concurrent, outside):
    assert spark.createDataFrame([(kind, item)], "change_type string, item string").select(guards.runs_outside(version, concurrent)).first()[0] is outside


def test_surviving_triggers_are_told_by_table(spark, tmp_path):
    spark.createDataFrame([(k, 4) for k in (1, 3, 9, 45)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = catalog_queries.surviving_triggers(spark, str(tmp_path))
    assert sorted(found.columns) == ["tbl", "triggers"] and {tuple(r) for r in found.select("tbl", "triggers").collect()} == {("t0", "trigger:trigger_3; trigger:trigger_9"), ("t40", "trigger:trigger_45")}


def test_grouped_lines_are_kept_while_they_are_read(spark):
    """Snapshots of the same line items group them once, and nothing stays behind."""
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    names = ("live_columns", "desired_columns", "renames")
    with generated.kept_lines(spark, SF) as lines:
        for whole, shared in zip(generated.frames(spark, SF, *names), generated.frames(spark, SF, *names, lines=lines)):
            assert "InMemoryTableScan" in shared._jdf.queryExecution().executedPlan().toString()
            assert rows(shared) == rows(whole)
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept + 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_normal_forms(spark):
    forms = {"(TRUE)": "true", "((-1.5))": "-1.5", "CURRENT_TIMESTAMP": "now()", "'it''s'::text": "'it''s'", "nextval('s.q'::regclass)": "nextval('q'::regclass)", "(foo)": "(foo)", "true)\n": "true", "nextval('')": "nextval('')", "": "", None: None}
    assert {raw: one(spark, raw, sqltypes.normalize_default) for raw in forms} == forms
    types = {"character varying(9)": "varchar(9)", "CHARACTER(2)": "char(2)", "character": "character", " int4 ": "integer", None: None}
    assert {raw: one(spark, raw, sqltypes.normalize_type) for raw in types} == types


def test_foreign_keys_meet_leading_columns_by_equality(spark):
    indexes = [("t", ["a", "b", "c"]), ("t", ["d"]), ("u", ["b", "a"]), ("v", []), ("v", ["a", None])]
    fks = [("t", "both", ["b", "a"]), ("t", "one", ["a"]), ("t", "late", ["b"]), ("t", "all", ["c", "a", "b"]), ("t", "more", ["a", "b", "c", "d"]), ("u", "swapped", ["a", "b"]), ("u", "second", ["a"]), ("v", "none", []), ("v", "empty", ["b"]), ("w", "alone", ["a"])]
    s = {"indexes": spark.createDataFrame(indexes, "tbl string, cols array<string>"), "keys": spark.createDataFrame([("t", ["d", "e"])], "tbl string, cols array<string>"), "fks": spark.createDataFrame(fks, "tbl string, name string, cols array<string>")}
    found = lint.unindexed_fk(s)
    assert {r["item"] for r in found.collect()} == {"late", "more", "second", "empty", "alone"}
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "sort" not in joins[0]


def test_checks_are_folded_once(spark):
    checks = [("t", "a", "CHECK ((x > 0))"), ("t", "b", "X>0"), ("t", "c", "()"), ("t", "d", "(( ))"), ("t", "e", " "), ("t", "f", None), ("u", "g", "x > 0"), ("t", "h", "(x>0)and(y>0)")]
    found = lint.duplicate_check({"checks": spark.createDataFrame(checks, "tbl string, name string, expr string")})
    assert [r["item"] for r in found.collect()] == ["b"]
    assert sum("regexp_replace" in line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 1


def test_lint_groups_line_items_once(spark):
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    with lint.snapshot(spark, SF) as s:
        assert "InMemoryTableScan" in s["columns"]._jdf.queryExecution().executedPlan().toString()
        assert rows(s["columns"]) == rows(generated.frame(spark, SF, "lint_columns")) and rows(s["keys"]) == rows(generated.frame(spark, SF, "lint_keys"))
    assert lint.lint_counts(spark, SF).count() == 3 and spark.sparkContext._jsc.getPersistentRDDs().size() == kept
