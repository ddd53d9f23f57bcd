"""Where snapshots come from: the schemas of DataFrames, and documents of plans and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL names of Spark's simple types.
SQL_NAMES = {"tinyint": "smallint", "smallint": "smallint", "int": "integer", "bigint": "bigint", "float": "real", "double": "double precision", "string": "text", "boolean": "boolean", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "binary": "bytea"}
COLUMN_KINDS = "tbl string, col string, data_type string, nullable boolean, dflt string, generated string, place int"


def sql_name(spark_type: str) -> str:
    if spark_type.startswith("decimal"):
        return spark_type.replace("decimal", "numeric")
    if spark_type.startswith("array<"):
        return sql_name(spark_type[6:-1]) + "[]"
    return SQL_NAMES.get(spark_type, spark_type)


def columns_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each column of the given tables, as the snapshots of catalpa.plans have it; only schemas are read."""
    rows = [(name, f.name, sql_name(f.dataType.simpleString()), f.nullable, "", "", i + 1) for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, COLUMN_KINDS)


def key_columns(constraints: DataFrame, attributes: DataFrame) -> DataFrame:
    """(rel, name, cols): the columns of keys, given by their places (an array), in the key's order; places that no attribute (rel, place, col) has are left out."""
    each = constraints.select("rel", "name", F.posexplode("places").alias("at", "place"))
    named = each.join(attributes, ["rel", "place"])
    return named.groupBy("rel", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "col"))), lambda x: x["col"]).alias("cols"))


def dependency_edges(*sides: DataFrame) -> DataFrame:
    """The distinct edges (view_name, kind, needs) of all sides."""
    found = sides[0].distinct()
    for side in sides[1:]:
        found = found.union(side.distinct())
    return found.distinct()


#: The privilege that a letter of an access list stands for.
LETTERS = {"r": "SELECT", "a": "INSERT", "w": "UPDATE", "d": "DELETE", "D": "TRUNCATE", "x": "REFERENCES", "t": "TRIGGER", "U": "USAGE", "X": "EXECUTE", "C": "CREATE"}


def acl_rows(objects: DataFrame, roles: DataFrame) -> DataFrame:
    """(kind, obj, grantee, privilege, grantable): a row for each privilege in the access lists (acl: `role id=letters`, split by semicolons).

    A letter with an asterisk may be passed on; id 0 is PUBLIC; an id that no role has is written as a number.
    """
    each = objects.select("kind", "obj", F.explode(F.filter(F.split("acl", ";"), lambda a: a != "")).alias("entry"))
    entry = F.split("entry", "=")
    each = each.select("kind", "obj", entry[0].cast("long").alias("id"), F.explode(F.regexp_extract_all(entry[1], F.lit("[A-Za-z][*]?"), F.lit(0))).alias("letter"))
    named = each.join(roles.select("id", "role"), "id", "left")
    spelled = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])[F.substring("letter", 1, 1)]
    return named.select("kind", "obj", F.when(F.col("id") == 0, "PUBLIC").otherwise(F.coalesce("role", F.col("id").cast("string"))).alias("grantee"), spelled.alias("privilege"), (F.length("letter") > 1).alias("grantable"))


def role_settings(roles: DataFrame) -> DataFrame:
    """(role, setting, value): a row for each entry name=value of the roles' settings, an array."""
    each = roles.select("role", F.explode("settings").alias("s"))
    return each.select("role", F.substring_index("s", "=", 1).alias("setting"), F.regexp_extract("s", "^[^=]*=(.*)$", 1).alias("value"))


PLAN_KINDS = "struct<format_version:int, hash:string, steps:array<struct<change_type:string, schema:string, tbl:string, sql_text:string, destructive:boolean, non_tx:boolean>>>"


def plan_steps(spark: SparkSession, path: str) -> DataFrame:
    """Steps of plan documents (one JSON text a file): file, idx and the step's fields; broken_plans tells the documents that have none."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", PLAN_KINDS).alias("p"))
    return texts.select("file", F.posexplode("p.steps").alias("idx", "s")).select("file", "idx", "s.*")


def broken_plans(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold no plan document."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", PLAN_KINDS).alias("p"))
    return texts.where("p.steps IS NULL").select("file")


def parsed_plans(documents: DataFrame) -> DataFrame:
    """(plan_id, idx, change_type, tbl, sql_text) of documents (plan_id, document); one that doesn't parse has no steps."""
    parsed = documents.select("plan_id", F.from_json("document", PLAN_KINDS).alias("p"))
    return parsed.select("plan_id", F.posexplode("p.steps").alias("idx", "s")).select("plan_id", "idx", "s.change_type", "s.tbl", "s.sql_text")


def plan_documents(steps: DataFrame, plan: str = "plan_id") -> DataFrame:
    """(plan_id, hash, document): steps in order of idx as JSON, with the SHA-256 of their texts one to a line."""
    fields = [c for c in steps.columns if c != plan]
    grouped = steps.groupBy(plan).agg(F.sort_array(F.collect_list(F.struct("idx", *[c for c in fields if c != "idx"]))).alias("steps"))
    digest = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat_ws("|", s["change_type"], s["tbl"], s["sql_text"])), "\n"), 256)
    return grouped.select(plan, digest.alias("hash"), F.to_json(F.struct(digest.alias("hash"), "steps")).alias("document"))


def append_records(records: DataFrame, path: str) -> None:
    """Add rows to a ledger; records are never changed in place."""
    records.write.mode("append").parquet(path)
