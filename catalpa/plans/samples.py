"""Two small snapshots of one schema, live and desired, and steps of a plan: inputs of the registered catalogue queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rows:
    """Inline rows, for Spark as a DataFrame and for SQL as a VALUES list."""

    columns: str  # "name type, ..."
    rows: tuple

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.columns)

    def sql(self, name: str) -> str:
        kinds = [c.split() for c in self.columns.split(", ")]
        lines = ", ".join("(" + ", ".join(literal(v, k) for v, (_, k) in zip(row, kinds)) + ")" for row in self.rows)
        return f"{name}({', '.join(c for c, _ in kinds)}) AS (VALUES {lines})"


def literal(value, kind: str) -> str:
    if kind.startswith("array"):
        return "CAST([" + ", ".join(literal(v, "string") for v in value) + "] AS VARCHAR[])"
    if value is None:
        return {"string": "CAST(NULL AS VARCHAR)", "boolean": "CAST(NULL AS BOOLEAN)"}.get(kind, "NULL")
    return str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


COLUMNS = "tbl string, col string, data_type string, nullable boolean, dflt string, generated string"
LIVE_COLUMNS = Rows(COLUMNS, (
    ("users", "id", "bigint", False, "", ""),
    ("users", "email", "varchar(255)", False, "", ""),
    ("users", "first_name", "text", True, "", ""),
    ("users", "age", "int4", True, "", ""),
    ("users", "score", "double precision", True, "(0)", ""),
    ("users", "legacy", "text", True, "", ""),
    ("orders", "id", "bigint", False, "nextval('public.orders_id_seq'::regclass)", ""),
    ("orders", "amount", "numeric(10,2)", False, "", ""),
    ("orders", "total", "numeric(12,2)", True, "", "amount * 2"),
    ("orders", "state", "text", True, "'new'::text", ""),
    ("audit_log", "entry", "text", True, "", ""),
    ("spatial_ref_sys", "srid", "integer", False, "", ""),
))
DESIRED_COLUMNS = Rows(COLUMNS, (
    ("users", "id", "int8", False, "", ""),
    ("users", "email", "character varying(100)", False, "", ""),
    ("users", "given_name", "text", True, "", ""),
    ("users", "age", "bigint", False, "", ""),
    ("users", "score", "float8", True, "0", ""),
    ("users", "nickname", "text", True, "", ""),
    ("orders", "id", "bigint", False, "nextval('orders_id_seq'::regclass)", ""),
    ("orders", "amount", "numeric(8,2)", False, "", ""),
    ("orders", "total", "numeric(12,2)", True, "", "amount * 3"),
    ("orders", "state", "text", False, "'open'", ""),
    ("orders", "user_id", "bigint", False, "", ""),
    ("invoices", "id", "bigint", False, "", ""),
    ("invoices", "paid", "boolean", True, "", ""),
))
RENAMES = Rows("old_name string, new_name string", (("users.first_name", "given_name"),))

OBJECTS = "kind string, tbl string, name string, definition string, valid boolean"
LIVE_OBJECTS = Rows(OBJECTS, (
    ("index", "users", "ix_email", "(email)", True),
    ("index", "users", "ix_age", "(age)", True),
    ("index", "orders", "ix_broken", "(amount)", False),
    ("index", "orders", "ix_state", "(state)", True),
    ("fk", "orders", "fk_user", "(user_id) -> users(id)", True),
    ("fk", "orders", "fk_later", "(amount) -> rates(id)", False),
    ("fk", "orders", "fk_gone", "(state) -> states(id)", True),
    ("check", "users", "users_age_check", "age > 0", True),
    ("check", "users", "age_sane", "age < 200", True),
    ("check", "orders", "amount_min", "amount > 0", True),
    ("trigger", "users", "tr_touch", "touch()", True),
    ("trigger", "users", "tr_old", "old()", True),
    ("comment", "users", "", "people", True),
    ("comment", "orders", "", "sales", True),
    ("sequence", "", "invoice_no", "start 1 by 1", True),
    ("sequence", "", "unused_no", "start 1 by 1", True),
))
DESIRED_OBJECTS = Rows(OBJECTS, (
    ("index", "users", "ix_email", "(email)", True),
    ("index", "users", "ix_age", "(age, email)", True),
    ("index", "orders", "ix_broken", "(amount)", True),
    ("index", "orders", "ix_user", "(user_id)", True),
    ("fk", "orders", "fk_user", "(user_id) -> users(id) cascade", True),
    ("fk", "orders", "fk_later", "(amount) -> rates(id)", True),
    ("fk", "invoices", "fk_new", "(id) -> orders(id)", True),
    ("check", "users", "age_sane", "age < 150", True),
    ("check", "orders", "amount_min", "amount > 0", True),
    ("check", "orders", "state_known", "state <> ''", True),
    ("trigger", "users", "tr_touch", "touch_all()", True),
    ("comment", "users", "", "people and bots", True),
    ("comment", "orders", "", "", True),
    ("sequence", "", "invoice_no", "start 1 by 10", True),
    ("sequence", "", "ticket_no", "start 1 by 1", True),
))

ENUMS = "name string, label string, pos int"
LIVE_ENUMS = Rows(ENUMS, (("mood", "sad", 1), ("mood", "ok", 2), ("mood", "happy", 3), ("old", "x", 1)))
DESIRED_ENUMS = Rows(ENUMS, (("mood", "ok", 1), ("mood", "glad", 2), ("mood", "sad", 3), ("mood", "calm", 4), ("size", "s", 1), ("size", "l", 2)))
ENUM_RENAMES = Rows("old_name string, new_name string", (("enum.mood.happy", "glad"),))

VIEWS = "name string, definition string, materialised boolean, cols array<string>"
LIVE_VIEWS = Rows(VIEWS, (("v_same", "q1", False, ["a"]), ("v_wider", "q2", False, ["a", "b"]), ("v_other", "q3", False, ["a", "b"]), ("m_daily", "q4", True, ["d"]), ("v_gone", "q5", False, ["z"])))
DESIRED_VIEWS = Rows(VIEWS, (("v_same", "q1", False, ["a"]), ("v_wider", "q2b", False, ["a", "b", "c"]), ("v_other", "q3b", False, ["b", "a"]), ("m_daily", "q4b", True, ["d"]), ("v_new", "q6", False, ["n"])))

POLICIES = "tbl string, name string, cmd string, permissive boolean, roles array<string>, using_expr string, check_expr string"
LIVE_POLICIES = Rows(POLICIES, (
    ("users", "p_same", "SELECT", True, [], "true", ""),
    ("users", "p_using", "ALL", True, ["app"], "id = 1", ""),
    ("users", "p_cmd", "SELECT", True, ["app"], "true", ""),
    ("users", "p_less", "UPDATE", True, ["app"], "true", "id > 0"),
    ("users", "p_gone", "ALL", True, ["app"], "true", ""),
))
DESIRED_POLICIES = Rows(POLICIES, (
    ("users", "p_same", "SELECT", True, ["public"], "true", ""),
    ("users", "p_using", "ALL", True, ["App "], "id = 2", ""),
    ("users", "p_cmd", "UPDATE", True, ["app"], "true", ""),
    ("users", "p_less", "UPDATE", True, ["app"], "true", ""),
    ("users", "p_new", "ALL", True, ["app"], "true", ""),
))

GRANTS = "kind string, obj string, grantee string, privileges array<string>"
LIVE_GRANTS = Rows(GRANTS, (("table", "users", "app", ["SELECT", "INSERT"]), ("table", "orders", "app", ["SELECT", "DELETE"]), ("table", "users", "PUBLIC", ["SELECT"]), ("table", "orders", "report", ["SELECT"])))
DESIRED_GRANTS = Rows(GRANTS, (("table", "users", "app", ["INSERT", "SELECT"]), ("table", "orders", "app", ["SELECT", "UPDATE"]), ("sequence", "invoice_no", "app", ["USAGE"])))

STEPS = Rows("idx int, change_type string, tbl string, destructive boolean, non_tx boolean, narrowed boolean, generated boolean, not_null boolean, dflt string, unmanaged boolean, candidate boolean, rebuild boolean, sql_text string", (
    (0, "DROP_TABLE", "old", True, False, False, False, False, "", False, False, False, "drop old"),
    (1, "ADD_COLUMN", "users", False, False, False, False, True, "", False, False, False, "add a"),
    (2, "ADD_COLUMN", "users", False, False, False, False, True, "0", False, False, False, "add b"),
    (3, "ALTER_COLUMN", "users", True, False, True, False, False, "", False, False, False, "alter c"),
    (4, "ALTER_COLUMN", "users", False, False, False, False, False, "", True, False, False, "alter d"),
    (5, "ALTER_COLUMN", "orders", False, False, False, True, False, "", False, False, False, "alter e"),
    (6, "DROP_COLUMN", "users", True, False, False, False, False, "", True, True, False, "drop f"),
    (7, "CREATE_INDEX", "orders", False, True, False, False, False, "", False, False, False, "index g"),
    (8, "ADD_FK", "orders", False, False, False, False, False, "", False, False, False, "fk h"),
    (9, "VALIDATE_CONSTRAINT", "orders", False, False, False, False, False, "", False, False, False, "validate h"),
    (10, "DROP_TRIGGER", "users", True, False, False, False, False, "", False, False, True, "drop trigger i"),
    (11, "DROP_ENUM_VALUE", "", True, False, False, False, False, "", False, False, False, "drop value j"),
    (12, "CREATE_TABLE", "invoices", False, False, False, False, False, "", False, False, False, "create k"),
    (13, "GRANT", "users", False, False, False, False, False, "", False, False, False, "grant l"),
    (14, "REVOKE", "users", True, False, False, False, False, "", False, False, False, "revoke m"),
    (15, "COMMENT_TABLE", "users", False, False, False, False, False, "", False, False, False, "comment n"),
))
EDGES = Rows("node string, needs string", (("posts", "users"), ("comments", "posts"), ("likes", "comments"), ("likes", "users"), ("tags", "posts"), ("a", "b"), ("b", "a"), ("c", "a")))
