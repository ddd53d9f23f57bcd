"""What stands against a step: roles that can't be dropped, and steps that can't run in a transaction.

A role can be dropped only if it owns nothing and no access entry names it but those that the same plan revokes: on tables, views and sequences, plain functions and the schemas
themselves, of the schemas at hand, and on the database at hand. Everything else, default access and objects of other kinds too, refuses the drop.

Owners and entries are counted by role with partial aggregates before they meet the roles, so a role that owns a third of everything is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalpa.plans import catalog, generated, vocabulary
from catalpa.session import table

#: Catalogues whose rows have an owner; a member row counts for the role and for its member.
OWNED = (
    "database", "schema", "relation", "type", "function", "language", "publication", "default access", "member", "extension", "foreign data wrapper",
    "foreign server", "event trigger", "subscription", "tablespace", "collation", "conversion", "large object",
)
#: Relations whose entries a plan revokes: tables, partitioned tables, views, materialised views, foreign tables, sequences.
REVOKED_RELATIONS = ("r", "p", "v", "m", "f", "S")
#: Fixed value: the server version from which a partition can be detached concurrently.
CONCURRENT_DETACH = 140000


def is_revoked(schemas: tuple[str, ...]) -> Column:
    """Whether a plan over the schemas revokes an entry (kind, sch, detail, here): detail is a relation's or function's kind, here tells the database at hand."""
    inside = F.coalesce(F.col("sch").isin(*schemas), F.lit(False)) if schemas else F.lit(False)
    kind = F.col("kind")
    own = F.when(kind == "relation", inside & F.col("detail").isin(*REVOKED_RELATIONS)).when(kind == "function", inside & (F.col("detail") == "f")).when(kind == "schema", inside).when(kind == "database", F.col("here"))
    return F.coalesce(own, F.lit(False))


def role_guards(roles: DataFrame, owners: DataFrame, entries: DataFrame, schemas: tuple[str, ...]) -> DataFrame:
    """(role, owned, unhandled, may_drop) of roles (id, role): rows of owners (catalog, owner) and entries (kind, sch, detail, here, grantee) that stand against a drop."""
    mine = owners.groupBy(F.col("owner").alias("o")).agg(F.count("*").alias("owned"))
    left = entries.where(~is_revoked(schemas)).groupBy(F.col("grantee").alias("g")).agg(F.count("*").alias("unhandled"))
    told = roles.join(mine, F.col("id") == F.col("o"), "left").join(left, F.col("id") == F.col("g"), "left")
    zero = F.lit(0).cast("long")
    return told.select("role", F.coalesce("owned", zero).alias("owned"), F.coalesce("unhandled", zero).alias("unhandled"), (F.col("owned").isNull() & F.col("unhandled").isNull()).alias("may_drop"))


def runs_outside(server_version: int, concurrent: bool = True) -> Column:
    """Whether a step (change_type, item) can't run in a transaction: a detach doesn't, where it is made concurrently, which needs a server that can, no
    partition for all other rows and no earlier detach to end."""
    detach = (F.col("change_type") == "DETACH_PARTITION") & ~F.col("item").isin("default", "pending")
    return F.col("change_type").isin(*vocabulary.OUTSIDE_TRANSACTIONS) | (detach & F.lit(concurrent and server_version >= CONCURRENT_DETACH))


ROLES = "SELECT c % 500 AS id, 'role' || {id} AS role FROM {people} GROUP BY c % 500"
OWNERS = f"SELECT {generated.choose('c', OWNED)} AS catalog, k % 700 AS owner FROM {{rows}} WHERE k % 700 < 350 AND c % 3 = 0"
ENTRIES = f"""SELECT {generated.choose('c', ('relation', 'function', 'schema', 'database', 'default access', 'relation', 'relation'))} AS kind, 's' || {{sch}} AS sch,
    CASE c % 7 WHEN 1 THEN {generated.choose('k', ('f', 'f', 'p', 'f'))} ELSE {generated.choose('k', ('r', 'S', 'v', 'r', 'i'))} END AS detail, k % 5 > 0 AS here, k * 3 % 900 AS grantee FROM {{rows}} WHERE c % 10 < 2"""
SCHEMAS = ("s0", "s1", "s2", "s3")


def sql(text: str, spark_side: bool) -> str:
    people, rows = ("{customer}", "{orders}") if spark_side else ("customer", "orders")
    return text.format(people=f"(SELECT c_custkey AS c FROM {people}) AS x", rows=f"(SELECT o_orderkey AS k, o_custkey AS c FROM {rows}) AS x", id=generated.text("c % 500"), sch=generated.text("k % 5"))


def role_drops(spark, sf_dir: str) -> DataFrame:
    people, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    owners, entries = spark.sql(sql(OWNERS, True), orders=orders), spark.sql(sql(ENTRIES, True), orders=orders)
    return role_guards(spark.sql(sql(ROLES, True), customer=people), owners, entries, SCHEMAS)


def detach_modes(spark, sf_dir: str) -> DataFrame:
    """Steps on partitions, and whether each runs outside a transaction on servers old and new."""
    steps = catalog.partition_changes(*generated.frames(spark, sf_dir, "live_tables", "desired_tables"))
    return steps.select("sch", "tbl", "seq", "change_type", runs_outside(130000).alias("before"), runs_outside(150000).alias("since"), runs_outside(150000, concurrent=False).alias("plain"))


QUERIES = {f.__name__: f for f in (role_drops, detach_modes)}


def detach_sql() -> str:
    from catalpa.plans.catalog_queries import ORACLES as catalogs

    return "WITH every AS (" + catalogs["diff_partitions"] + ") SELECT sch, tbl, seq, change_type, false AS before, change_type = 'DETACH_PARTITION' AND item = '' AS since, false AS plain FROM every"


ORACLES = {
    "role_drops": f"""
        WITH r AS ({sql(ROLES, False)}), o AS ({sql(OWNERS, False)}), e AS ({sql(ENTRIES, False)}),
        c AS (SELECT role, (SELECT count(*) FROM o WHERE owner = id) AS owned, (SELECT count(*) FROM e WHERE grantee = id AND NOT (
            (kind = 'relation' AND detail IN ('r', 'p', 'v', 'm', 'f', 'S') AND sch < 's4') OR (kind = 'function' AND detail = 'f' AND sch < 's4') OR (kind = 'schema' AND sch < 's4') OR (kind = 'database' AND here))) AS unhandled FROM r)
        SELECT role, owned, unhandled, owned + unhandled = 0 AS may_drop FROM c""",
    "detach_modes": detach_sql(),
}
