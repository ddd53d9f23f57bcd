"""Queries whose snapshot is the schema of the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalpa.operators import lint
from catalpa.plans import generated
from catalpa.plans.generated import twin
from catalpa.session import table
from catalpa.sources import snapshots

TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


def schema_columns(spark, sf_dir):
    return snapshots.columns_of(spark, {t: table(spark, sf_dir, t) for t in TABLES}).select("tbl", "col", "data_type", "place")


def float_money_columns(spark, sf_dir):
    """Columns of the tables that hold money in floating point."""
    return lint.float_money({"columns": schema_columns(spark, sf_dir)})


def split(name):
    return F.filter(F.split(name, ","), lambda x: x != "")


def key_columns(spark, sf_dir):
    constraints, attributes = generated.frames(spark, sf_dir, "constraints", "attributes")
    found = snapshots.key_columns(constraints.withColumn("places", split("places").cast("array<int>")), attributes)
    return found.select("rel", "name", F.array_join("cols", ",").alias("cols"))


def dependency_edges(spark, sf_dir):
    links = generated.frame(spark, sf_dir, "view_links")
    return snapshots.dependency_edges(links.where("kind = 'table'"), links.where("kind = 'routine'"))


def acl_rows(spark, sf_dir):
    return snapshots.acl_rows(*generated.frames(spark, sf_dir, "acls", "role_ids"))


def role_settings(spark, sf_dir):
    return snapshots.role_settings(generated.frame(spark, sf_dir, "role_ids").withColumn("settings", split("settings")))


def documents(spark, sf_dir):
    steps = generated.frame(spark, sf_dir, "steps").select("plan_id", "idx", "change_type", "tbl", "sql_text")
    return snapshots.plan_documents(steps)


def plan_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("plan_id", "hash")


def plan_round_trip(spark, sf_dir):
    """Steps written as plan documents and read back, with their new places."""
    return snapshots.parsed_plans(documents(spark, sf_dir).select("plan_id", "document"))


QUERIES = {f.__name__: f for f in (schema_columns, float_money_columns, key_columns, dependency_edges, acl_rows, role_settings, plan_documents, plan_round_trip)}
ORACLES = {
    "key_columns": twin(", e AS (SELECT rel, name, unnest(string_split(places, ',')) AS p, unnest(range(len(string_split(places, ',')))) AS o FROM k) SELECT e.rel, e.name, string_agg(a.col, ',' ORDER BY o) AS cols FROM e JOIN a ON a.rel = e.rel AND a.place = CAST(e.p AS INTEGER) GROUP BY ALL", k="constraints", a="attributes"),
    "dependency_edges": twin(" SELECT DISTINCT view_name, kind, needs FROM v WHERE kind = 'table' UNION SELECT DISTINCT view_name, kind, needs FROM v WHERE kind = 'routine'", v="view_links"),
    "acl_rows": twin(
        """, e AS (SELECT kind, obj, unnest(string_split(acl, ';')) AS entry FROM o WHERE acl <> ''),
        p AS (SELECT kind, obj, CAST(split_part(entry, '=', 1) AS BIGINT) AS id, unnest(regexp_extract_all(split_part(entry, '=', 2), '[A-Za-z][*]?')) AS letter FROM e)
        SELECT kind, obj, CASE WHEN p.id = 0 THEN 'PUBLIC' ELSE coalesce(r.role, CAST(p.id AS VARCHAR)) END AS grantee, CASE letter[1] WHEN 'r' THEN 'SELECT' WHEN 'a' THEN 'INSERT' WHEN 'w' THEN 'UPDATE' WHEN 'd' THEN 'DELETE' WHEN 'D' THEN 'TRUNCATE' WHEN 'x' THEN 'REFERENCES' WHEN 't' THEN 'TRIGGER' WHEN 'U' THEN 'USAGE' END AS privilege, contains(letter, '*') AS grantable
        FROM p LEFT JOIN r ON r.id = p.id""", o="acls", r="role_ids"),
    "role_settings": twin(", e AS (SELECT role, unnest(string_split(settings, ',')) AS s FROM r WHERE settings <> '') SELECT role, split_part(s, '=', 1) AS setting, split_part(s, '=', 2) AS value FROM e", r="role_ids"),
    "plan_documents": twin(" SELECT plan_id, sha256(string_agg(change_type || '|' || tbl || '|' || sql_text, chr(10) ORDER BY idx)) AS hash FROM s GROUP BY plan_id", s="steps"),
    "plan_round_trip": twin(" SELECT plan_id, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY idx) - 1 AS INTEGER) AS idx, change_type, tbl, sql_text FROM s", s="steps"),
    "schema_columns": f"""SELECT table_name AS tbl, column_name AS col, CAST(ordinal_position AS INTEGER) AS place,
        CASE data_type WHEN 'VARCHAR' THEN 'text' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'double precision' WHEN 'TIMESTAMP' THEN 'timestamp' ELSE data_type END AS data_type
        FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)})""",
    "float_money_columns": f"""SELECT 'L032' AS rule, 'ERROR' AS severity, table_name AS tbl, column_name AS item FROM information_schema.columns
        WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)}) AND data_type IN ('FLOAT', 'DOUBLE') AND regexp_matches(column_name, 'amount|price|balance|cost|total|fee')""",
}
