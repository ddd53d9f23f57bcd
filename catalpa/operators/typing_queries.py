"""Queries over types, defaults, names and scopes, whose inputs are put together from the rows of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalpa.functions import sqltypes
from catalpa.plans import twins
from catalpa.plans.changes import over
from catalpa.plans.generated import choose, text
from catalpa.plans.samples import Rows
from catalpa.session import table

#: A type is a head with, where it takes them, a length or a precision and a scale.
BARE = ("smallint", "INT2", "int", "integer", "serial", "BIGINT", "int8", "real", "float4", "float8", "double precision", "text", "varchar", "char", "numeric", "decimal", "bool", "date", "jsonb", "timestamp without time zone", "timestamp with time zone", "time with time zone")
SIZED = ("varchar", "character varying", "char", "character", "numeric", "decimal")
PAIRS = f"""SELECT DISTINCT CASE WHEN p % 3 = 0 THEN {choose('p', BARE)} WHEN p % 3 = 1 THEN {choose('p', SIZED)} || '(' || {text('1 + p % 4')} || ')' ELSE 'numeric(' || {text('4 + p % 3')} || ',' || {text('p % 4')} || ')' END AS old,
    CASE WHEN u % 3 = 0 THEN {choose('u + p', BARE)} WHEN u % 3 = 1 THEN {choose('u', SIZED)} || '(' || {text('1 + u % 4')} || ')' ELSE 'numeric(' || {text('4 + u % 3')} || ', ' || {text('u % 4')} || ')' END AS new
    FROM (SELECT l_partkey AS p, l_suppkey AS u FROM {{lineitem}}) AS x"""
VALUES = ("'w'", "'it''s'", "'a)'", "7", "-2", "3.5", "TRUE", "False", "now()", "Current_Timestamp", "lower('x')", "nextval('app.ids'::regclass)", "nextval('ids'::regclass)", "")
CASTS = ("", "::text", "::character varying", "::numeric(8)")
DEFAULTS = f"""SELECT DISTINCT CASE WHEN p % 2 = 0 THEN '(' ELSE '' END || v || CASE WHEN v LIKE '''%' THEN {choose('z', CASTS)} ELSE '' END || CASE WHEN p % 2 = 0 THEN ')' ELSE '' END AS raw
    FROM (SELECT p, z, {choose('p + z', VALUES)} AS v FROM (SELECT p_partkey AS p, p_size AS z FROM {{part}}) AS a) AS x WHERE v <> ''"""
CALLS = f"""SELECT k, CASE k % 5 WHEN 0 THEN '"Sales"."Orders.' || {text('k')} || '"' WHEN 1 THEN 'Public.T' || {text('k')} WHEN 2 THEN '"a""b' || {text('k')} || '"' ELSE ' Plain' || {text('k')} END AS name,
    'alter role r password ''s' || {text('k')} || '''; create subscription s CONNECTION ''host=h' || {text('k')} || ''' end' AS statement FROM (SELECT o_orderkey AS k FROM {{orders}}) AS x"""
NAMES = Rows("name string", (("users",), ("user_notes",), ("tmp_1",), ("tmp_12",), ("spatial_ref_sys",), ("migration_ledger",), ("a/b",), ("weird[",)))


def rows(spark, sf_dir, sql, name):
    return spark.sql(sql, **{name: table(spark, sf_dir, name)})


def type_narrowing(spark, sf_dir):
    pairs = rows(spark, sf_dir, PAIRS, "lineitem")
    return pairs.select("old", "new", sqltypes.normalize_type(F.col("old")).alias("old_name"), sqltypes.normalize_type(F.col("new")).alias("new_name"), sqltypes.is_narrowing(F.col("old"), F.col("new")).alias("narrowing"))


def default_normalize(spark, sf_dir):
    return rows(spark, sf_dir, DEFAULTS, "part").select("raw", sqltypes.normalize_default(F.col("raw")).alias("plain"))


def names_and_secrets(spark, sf_dir):
    """Names as they are stored, and statements without their secrets."""
    found = rows(spark, sf_dir, CALLS, "orders")
    return found.select("k", F.array_join(sqltypes.qualified_name(F.col("name")), "/").alias("parts"), sqltypes.redacted(F.col("statement")).alias("statement"))


def scope_filter(spark, sf_dir):
    names = NAMES.frame(spark).select("name").unionByName(rows(spark, sf_dir, "SELECT DISTINCT lower(replace(p_type, ' ', '_')) || '_' || CAST(p_size AS STRING) AS name FROM {part}", "part"))
    return names.select("name", sqltypes.is_managed(F.col("name"), includes=("*[a-z_]*", "weird["), excludes=("tmp_?", "*_1?")).alias("managed"))


QUERIES = {f.__name__: f for f in (type_narrowing, default_normalize, names_and_secrets, scope_filter)}


def inner(sql: str) -> str:
    return sql.replace("{lineitem}", "lineitem").replace("{part}", "part").replace("{orders}", "orders")


ORACLES = {
    "type_narrowing": f"WITH p AS ({inner(PAIRS)}), n AS MATERIALIZED (SELECT old, new, {twins.normal_type('old')} AS a, {twins.normal_type('new')} AS b FROM p) SELECT old, new, a AS old_name, b AS new_name, {twins.narrowing('a', 'b')} AS narrowing FROM n",
    "default_normalize": f"WITH d AS ({inner(DEFAULTS)}) SELECT raw, {twins.plain_default('raw')} AS plain FROM d",
    "names_and_secrets": f"""WITH x AS ({inner(CALLS)}) SELECT k, CASE k % 5 WHEN 0 THEN 'Sales/Orders.' || k WHEN 1 THEN 'public/t' || k WHEN 2 THEN 'a"b' || k ELSE 'plain' || k END AS parts,
        'alter role r password ''***''; create subscription s CONNECTION ''***'' end' AS statement FROM x""",
    "scope_filter": over(""", m AS (SELECT name FROM n UNION ALL SELECT DISTINCT lower(replace(p_type, ' ', '_')) || '_' || p_size FROM part)
        SELECT name, name NOT IN ('spatial_ref_sys', 'migration_ledger') AND NOT regexp_full_match(name, 'tmp_[^/]') AND NOT regexp_full_match(name, '[^/]*_1[^/]') AND (name = 'weird[' OR regexp_full_match(name, '[^/]*[a-z_][^/]*')) AS managed FROM m""", n=NAMES),
}
