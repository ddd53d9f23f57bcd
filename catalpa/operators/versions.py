"""Tables rebuilt beside the old one and swapped in only after a check: versioned folders and a pointer.

    versions/<name>/   the rows of one version, complete before anything refers to it
    pointer/           a row (version, name, at, rows, columns) for each swap, appended as one file

Readers take the folder that the pointer names. A swap writes the new rows, reads them back, compares count and digest with what the old version promises, and
appends to the pointer only then; a failed check or a run that breaks before leaves the old version in force. Of two swaps from one version
the first counts, the other is told that it lost.

Checks are sums over rows in any order: the rows of the new version must be, column by column as stated, those of the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalpa.operators.batches import backfill, rebuild
from catalpa.operators.digests import digest, row_hash
from catalpa.session import checkpoint, exists, new_folder, remove, table

POINTER = "version long, name string, at timestamp, rows long, columns array<string>"


class SwapRefused(Exception):
    """The new version isn't what was promised, or another one was faster; the old version stays."""


def history(spark: SparkSession, folder: str) -> DataFrame:
    """The swaps that counted, (version, name, at, rows, columns), oldest first."""
    if not exists(spark, f"{folder}/pointer"):
        return spark.createDataFrame([], POINTER)
    swaps = spark.read.schema(POINTER).parquet(f"{folder}/pointer")
    first = swaps.groupBy("version").agg(F.min(F.struct("at", "name", "rows", "columns")).alias("s"))
    return first.select("version", "s.name", "s.at", "s.rows", "s.columns").orderBy("version")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the version in force."""
    last = history(spark, folder).orderBy(F.desc("version")).first()  # one row
    if last is None:
        raise LookupError(f"{folder} holds no version")
    return spark.read.parquet(f"{folder}/versions/{last['name']}")


def point_to(spark: SparkSession, folder: str, version: int, name: str, rows: int, columns: list[str]) -> None:
    row = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(name).alias("name"), F.current_timestamp().alias("at"), F.lit(rows).cast("long").alias("rows"), F.array(*[F.lit(c) for c in columns]).alias("columns"))
    row.coalesce(1).write.mode("append").parquet(f"{folder}/pointer")
    if history(spark, folder).where(F.col("version") == version).first()["name"] != name:
        raise SwapRefused(f"another version {version} was swapped in first")


def create(df: DataFrame, folder: str) -> None:
    """The first version."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{folder}/versions/{name}")
    point_to(spark, folder, 1, name, spark.read.parquet(f"{folder}/versions/{name}").count(), df.columns)


def sums(df: DataFrame, columns: dict[str, str], kinds: dict[str, str]) -> tuple:
    """(rows, total, mix) of the expressions, under the names and types of the new version."""
    named = df.select(*[F.expr(said).cast(kinds[c]).alias(c) for c, said in columns.items()])
    return tuple(named.agg(*digest(row_hash(list(columns)))).first())


def swap(folder: str, new: DataFrame, promise: dict[str, str], never_null: tuple[str, ...] = ()) -> int:
    """Make `new` the version in force, if it has the old rows: each column of promise must hold what its expression over the old version says, row for row, and
    never_null columns no null. The new version's number; SwapRefused where the check fails, and the written folder is taken away."""
    spark = new.sparkSession
    old, version = current(spark, folder), history(spark, folder).agg(F.max("version")).first()[0] + 1
    name = uuid.uuid4().hex
    place = f"{folder}/versions/{name}"
    new.write.parquet(place)
    written = spark.read.parquet(place)
    kinds = dict(written.dtypes)
    was, now = sums(old, promise, kinds), sums(written, {c: f"`{c}`" for c in promise}, kinds)
    nulls = written.agg(F.count_if(F.lit(False)).alias("none"), *[F.count_if(F.col(c).isNull()).alias(c) for c in never_null]).first()
    if was != now or any(nulls):
        remove(spark, place)
        raise SwapRefused(f"rows {was[0]} and {now[0]}, digests {'equal' if was[1:] == now[1:] else 'differ'}, nulls {sum(nulls)}")
    point_to(spark, folder, version, name, now[0], new.columns)
    return version


def unused(spark: SparkSession, folder: str, keep: int = 1) -> list[str]:
    """Names of versions, in force before, that are older than the last `keep` ones."""
    names = [r["name"] for r in history(spark, folder).collect()]  # a row for each swap
    return names[: max(0, len(names) - keep)]


def forget(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Take away the rows of old versions; how many there were."""
    names = [n for n in unused(spark, folder, keep) if exists(spark, f"{folder}/versions/{n}")]
    for name in names:
        remove(spark, f"{folder}/versions/{name}")
    return len(names)


def rename_in_three(spark: SparkSession, folder: str, old: str, new: str, kind: str) -> list[tuple[str, bool]]:
    """A column renamed without a gap: expand (add), an early contract that must be refused, backfill, contract (drop); the steps and whether each was swapped in."""
    told = []

    def attempt(step: str, rows: DataFrame, promise: dict[str, str], never_null: tuple[str, ...] = ()) -> None:
        try:
            swap(folder, rows, promise, never_null)
            told.append((step, True))
        except SwapRefused:
            told.append((step, False))

    start = current(spark, folder)
    same = {c: f"`{c}`" for c in start.columns}
    rest = {c: k for c, k in start.dtypes if c != old}
    attempt("expand", rebuild(start, {**dict(start.dtypes), new: kind}), same)
    for step in ("early contract", "backfill", "contract"):
        at = current(spark, folder)
        if step == "backfill":
            attempt(step, backfill(at, new, old), same)
        else:
            attempt(step, rebuild(at, {**rest, new: kind}), {**{c: f"`{c}`" for c in rest}, new: f"`{old}`"}, (new,))
    return told


def customer_versions(spark, sf_dir: str) -> tuple[str, list[tuple[str, bool]]]:
    folder = new_folder(spark, "versions")
    create(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), folder)
    return folder, rename_in_three(spark, folder, "c_mktsegment", "segment", "string")


def swapped_customers(spark, sf_dir: str) -> DataFrame:
    """Customers after their segment was renamed in three checked swaps."""
    folder, _ = customer_versions(spark, sf_dir)
    whole = checkpoint(current(spark, folder).select("c_custkey", "c_nationkey", "segment"))
    remove(spark, folder)
    return whole


def swap_steps(spark, sf_dir: str) -> DataFrame:
    """The steps, whether each was swapped in, and the rows and columns of the version in force after it."""
    folder, steps = customer_versions(spark, sf_dir)
    version, places = 1, []
    for n, (step, moved) in enumerate(steps):
        version += moved
        places.append((n, step, moved, version))
    told = spark.createDataFrame(places, "n int, step string, moved boolean, v long")
    whole = checkpoint(told.join(history(spark, folder), F.expr("v = version")).select("step", "moved", "version", "rows", F.array_join(F.array_sort("columns"), ",").alias("columns")))
    remove(spark, folder)
    return whole


QUERIES = {f.__name__: f for f in (swapped_customers, swap_steps)}

ORACLES = {
    "swapped_customers": "SELECT c_custkey, c_nationkey, c_mktsegment AS segment FROM customer",
    "swap_steps": """
        WITH s AS (SELECT * FROM (VALUES ('expand', true, 2, 'c_custkey,c_mktsegment,c_nationkey,segment'), ('early contract', false, 2, 'c_custkey,c_mktsegment,c_nationkey,segment'),
            ('backfill', true, 3, 'c_custkey,c_mktsegment,c_nationkey,segment'), ('contract', true, 4, 'c_custkey,c_nationkey,segment')) AS t(step, moved, version, columns))
        SELECT step, moved, CAST(version AS BIGINT) AS version, (SELECT count(*) FROM customer) AS rows, columns FROM s""",
}
