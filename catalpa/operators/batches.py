"""Row work that schema changes need: keyset pages, chunked copy, backfill, rebuild, seeds, comparison of two row sets.

Each is one distributed pass; batch numbers are only reported, nothing loops over batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalpa.session import checkpoint, table


def keyset_page(df: DataFrame, key: list[str], cursor: tuple | None, size: int, pending: Column | None = None) -> DataFrame:
    """The next rows by key after the cursor that are still pending. Key columns must not be null."""
    page = df if pending is None else df.where(pending)
    if cursor is not None:
        after = F.lit(False)
        equal = F.lit(True)
        for column, value in zip(key, cursor, strict=True):
            after |= equal & (F.col(column) > F.lit(value))
            equal &= F.col(column) == F.lit(value)
        page = page.where((F.col(key[0]) >= F.lit(cursor[0])) & after)  # the first bound reaches the scan
    return page.orderBy(*key).limit(size)


def chunk_bounds(df: DataFrame, key: str | list[str], size: int, slices: int | None = None) -> DataFrame:
    """(chunk, first_key, last_key, rows) of chunks of so many rows by key; of a key of several columns the bounds are structs.

    Rows are numbered in two steps, so that no task holds them all: they are dealt by ranges of the whole key, sorted and counted within their range, then
    numbered on from the ranges before it. Only the rows at the ends of chunks are grouped. Rows of one key are sorted in one task. There are twice as many ranges as the session
    has shuffle partitions, if slices doesn't say.
    """
    slices = slices or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [key] if isinstance(key, str) else key
    bound = F.col(key) if isinstance(key, str) else F.struct(*columns)
    ordered = df.select(*columns).repartitionByRange(slices, *columns).sortWithinPartitions(*columns)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))  # its lower bits: from 0 in each range
    placed = checkpoint(ordered.select(*columns, F.spark_partition_id().alias("_slice"), place.alias("_place")))
    counts = placed.groupBy("_slice").agg(F.count("*").alias("_rows"), F.count_if(bound.isNull()).alias("_nulls"))
    by = Window.orderBy("_slice")  # a row for each slice
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = F.coalesce(F.sum("_rows").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("_slice", ahead.alias("_ahead"), F.sum("_rows").over(whole).alias("_last"), (F.sum("_nulls").over(whole) + 1).alias("_first"))
    numbered = placed.join(F.broadcast(before), "_slice").withColumn("_n", F.col("_ahead") + F.col("_place") + 1)
    ends = numbered.where(((F.col("_n") - 1) % size == 0) | (F.col("_n") % size == 0) | F.col("_n").isin(F.col("_first"), F.col("_last")))  # _first: the first key that isn't null
    return ends.groupBy((F.floor((F.col("_n") - 1) / size) + 1).alias("chunk")).agg(F.min(bound).alias("first_key"), F.max(bound).alias("last_key"), (F.max("_n") - F.min("_n") + 1).alias("rows"))


def backfill(df: DataFrame, new: str, old: str) -> DataFrame:
    """Fill new from old where it is null, for all rows at once, also past rows whose old value is null."""
    return df.withColumn(new, F.coalesce(F.col(new), F.col(old)))


def backfill_progress(df: DataFrame, new: str, old: str) -> DataFrame:
    """(nulls_before, nulls_after, rows) of a backfill, from one pass."""
    filled = F.coalesce(F.col(new), F.col(old))
    return df.agg(F.count_if(F.col(new).isNull()).alias("nulls_before"), F.count_if(filled.isNull()).alias("nulls_after"), F.count("*").alias("rows"))


def rebuild(df: DataFrame, columns: dict[str, str], generated: tuple[str, ...] = ()) -> DataFrame:
    """The rows under a new column list (name, type): common columns are copied by name, new ones null, generated ones left out."""
    own = set(df.columns)
    return df.select(*[(F.col(c) if c in own else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items() if c not in generated])


def one_of_each(seed: DataFrame, key: list[str], order: list[str], last: bool) -> DataFrame:
    """Of seed rows that share a key the first or last one by the order; a key that holds a null is no other's, so such rows all stay."""
    whole = F.lit(True)
    for c in key:
        whole &= F.col(c).isNotNull()
    pick = F.max if last else F.min
    rest = [c for c in seed.columns if c not in key]
    ordered = [c for c in order if c in rest] + [c for c in rest if c not in order]
    kept = seed.where(whole).groupBy(*key).agg(pick(F.struct(*ordered)).alias("__r") if ordered else F.count("*").alias("__n"))
    return kept.select(*key, *[F.col(f"__r.{c}").alias(c) for c in ordered]).select(*seed.columns).unionByName(seed.where(~whole))


def seed_ignore(target: DataFrame, seed: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Insert seed rows whose key is new; existing rows stay. Of seed rows that share a key the first by `order`, then by all columns, is inserted."""
    first = one_of_each(seed, key, order or [], last=False)
    return target.unionByName(first.join(target.select(*key), key, "left_anti").select(*target.columns))


def seed_upsert(target: DataFrame, seed: DataFrame, key: list[str], update: list[str], order: list[str] | None = None) -> DataFrame:
    """Insert seed rows whose key is new and take the update columns of the others. Of seed rows that share a key the last by `order`, then by all columns, counts."""
    last = one_of_each(seed, key, order or [], last=True)
    mine = last.select(*key, F.lit(True).alias("__seed"), *[F.col(c).alias(f"__{c}") for c in target.columns if c not in key])
    both = target.withColumn("__old", F.lit(True)).join(mine, key, "full_outer")
    fresh = F.col("__old").isNull()
    columns = [F.col(c) if c in key else F.when(fresh | (F.col("__seed").isNotNull() if c in update else F.lit(False)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in target.columns]
    return both.select(*columns)


def row_level_diff(live: DataFrame, desired: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """(key, change): rows only desired, only live, or with a differing column; equal rows are left out."""
    a = live.select(*key, F.struct(*compare).alias("live"))
    b = desired.select(*key, F.struct(*compare).alias("desired"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("live").isNull(), "added").when(F.col("desired").isNull(), "removed").when(~F.col("live").eqNullSafe(F.col("desired")), "changed")
    return both.select(*key, change.alias("change")).where("change IS NOT NULL")


def page_single(spark, sf_dir: str) -> DataFrame:
    return keyset_page(table(spark, sf_dir, "orders"), ["o_orderkey"], (500,), 100).select("o_orderkey", "o_custkey", "o_orderstatus")


def page_composite(spark, sf_dir: str) -> DataFrame:
    return keyset_page(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], (7, 1), 50, F.col("role") == "user").select("conv_id", "turn", "role")


def chunks(spark, sf_dir: str) -> DataFrame:
    return chunk_bounds(table(spark, sf_dir, "orders"), "o_orderkey", 1000)


def chunks_composite(spark, sf_dir: str) -> DataFrame:
    found = chunk_bounds(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], 100)
    return found.select("chunk", *[F.col(f"{end}_key.{c}").alias(f"{end}_{c}") for end in ("first", "last") for c in ("conv_id", "turn")], "rows")


def nullable_events(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END").alias("score"), F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END").alias("old_score"))


def backfill_copy(spark, sf_dir: str) -> DataFrame:
    return backfill(nullable_events(spark, sf_dir), "score", "old_score").select("event_id", "score")


def backfill_counts(spark, sf_dir: str) -> DataFrame:
    return backfill_progress(nullable_events(spark, sf_dir), "score", "old_score")


def rebuild_project(spark, sf_dir: str) -> DataFrame:
    columns = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint", "c_note": "string"}
    return rebuild(table(spark, sf_dir, "customer"), columns)


def rebuild_checksum(spark, sf_dir: str) -> DataFrame:
    """Rows and checksums of line items before and after a column is dropped."""
    items = table(spark, sf_dir, "lineitem")
    kept = {c: k for c, k in items.dtypes if c != "l_tax"}
    total = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("rows"), F.sum("l_partkey").alias("parts"), F.sum(F.round(F.col("l_quantity")).cast("long")).alias("quantity"))
    return total(items, "before").unionByName(total(rebuild(items, kept), "after"))


SEED = [(3, "EUROPE AND MORE"), (5, "ARCTIC"), (6, "ANTARCTIC"), (3, "EUROPE AND LESS"), (6, "SOUTH"), (6, "SOUTH")]


def seed_frame(spark):
    return spark.createDataFrame(SEED, "r_regionkey int, r_name string")


def seed_ignored(spark, sf_dir: str) -> DataFrame:
    return seed_ignore(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), seed_frame(spark), ["r_regionkey"])


def seed_upserted(spark, sf_dir: str) -> DataFrame:
    return seed_upsert(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), seed_frame(spark), ["r_regionkey"], ["r_name"])


def order_diff(spark, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    desired = live.where("o_orderkey % 10 <> 3").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END"))
    desired = desired.unionByName(live.where("o_orderkey % 50 = 1").withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    return row_level_diff(live, desired, ["o_orderkey"], ["o_orderstatus", "o_custkey"])


QUERIES = {
    "keyset_page": page_single,
    "keyset_page_composite": page_composite,
    "chunk_bounds": chunks,
    "chunk_bounds_composite": chunks_composite,
    "backfill_copy": backfill_copy,
    "backfill_progress": backfill_counts,
    "rebuild_project": rebuild_project,
    "rebuild_checksum": rebuild_checksum,
    "seed_ignore": seed_ignored,
    "seed_upsert": seed_upserted,
    "row_level_diff": order_diff,
}

VALUES = ", ".join(f"({k}, '{n}')" for k, n in SEED)
ORACLES = {
    "keyset_page": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100",
    "keyset_page_composite": "SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND (conv_id, turn) > (7, 1) ORDER BY conv_id, turn LIMIT 50",
    "chunk_bounds": """
        SELECT chunk, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS rows FROM (
            SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS BIGINT) AS chunk FROM orders) GROUP BY chunk""",
    "chunk_bounds_composite": """
        SELECT chunk, min_by(conv_id, n) AS first_conv_id, min_by(turn, n) AS first_turn, max_by(conv_id, n) AS last_conv_id, max_by(turn, n) AS last_turn, count(*) AS rows
        FROM (SELECT *, CAST((n - 1) // 100 + 1 AS BIGINT) AS chunk FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations)) GROUP BY chunk""",
    "backfill_copy": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value WHEN event_id % 11 <> 0 THEN value END AS score FROM events",
    "backfill_progress": "SELECT count(*) FILTER (WHERE event_id % 3 = 0) AS nulls_before, count(*) FILTER (WHERE event_id % 33 = 0) AS nulls_after, count(*) AS rows FROM events",
    "rebuild_project": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(NULL AS VARCHAR) AS c_note FROM customer",
    "rebuild_checksum": """
        SELECT side, count(*) AS rows, CAST(sum(l_partkey) AS BIGINT) AS parts, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS quantity
        FROM lineitem, (VALUES ('before'), ('after')) AS s(side) GROUP BY side""",
    "seed_ignore": f"""
        SELECT r_regionkey, r_name FROM region UNION ALL SELECT k, min(n) FROM (VALUES {VALUES}) AS s(k, n) WHERE k NOT IN (SELECT r_regionkey FROM region) GROUP BY k""",
    "seed_upsert": f"""
        SELECT coalesce(k, r_regionkey) AS r_regionkey, CASE WHEN k IS NOT NULL THEN n ELSE r_name END AS r_name
        FROM region FULL OUTER JOIN (SELECT k, max(n) AS n FROM (VALUES {VALUES}) AS s(k, n) GROUP BY k) ON r_regionkey = k""",
    "row_level_diff": """
        WITH d AS (
            SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_custkey AS c FROM orders WHERE o_orderkey % 10 <> 3
            UNION ALL SELECT -o_orderkey - 1, o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 50 = 1)
        SELECT coalesce(o.o_orderkey, d.o_orderkey) AS o_orderkey,
               CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN d.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM orders o FULL OUTER JOIN d ON o.o_orderkey = d.o_orderkey
        WHERE o.o_orderkey IS NULL OR d.o_orderkey IS NULL OR o.o_orderstatus IS DISTINCT FROM d.s OR o.o_custkey IS DISTINCT FROM d.c""",
}
