"""Comparison of two large row sets by digests first: only where digests differ are rows met.

Rows of both sides fall into buckets by their key: ranges of a leading whole-number key, else hashes of the key. A bucket's digest doesn't depend on the order of rows: the
count, the sum of the hashes' upper halves and the xor of the hashes. Buckets with equal digests are done. The rest are split into SPLIT finer ones by a hash of
the whole key and told again; only rows of fine buckets that still differ are joined. Where few rows have changed, few are shuffled; digests are summed in the tasks
that read the rows, and where a table's files follow its key, a task holds few buckets.

Two different buckets pass as equal only if count, sum and xor of 64-bit hashes all agree (less than one in 2**64).

Defined cases: as row_level_diff: keys must be unique on each side and not null; nulls are told from values and equal each other; an empty side makes every row added or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from catalpa.operators.batches import row_level_diff
from catalpa.session import checkpoint, small, table

#: About so many rows a bucket, and fine buckets in each.
RANGE_ROWS = 256
SPLIT = 16


def row_hash(columns: list[str]) -> Column:
    """A 64-bit hash of the values and of which are null."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def digest(h: Column) -> list[Column]:
    """(rows, total, mix) of hashes, in any order."""
    return [F.count("*").alias("rows"), F.sum(F.shiftright(h, 32)).alias("total"), F.bit_xor(h).alias("mix")]


def buckets(live: DataFrame, desired: DataFrame, key: list[str], rows: int) -> Column:
    """The bucket of a row: a range of the leading key, where it is a whole number, so wide that it holds about `rows` of the larger side."""
    sides = [side.agg(F.count("*").alias("n"), F.min(key[0]).alias("low"), F.max(key[0]).alias("high")).first() for side in (live, desired)]
    n = max(1, -(-max(s["n"] for s in sides) // rows))
    kinds = [side.schema[key[0]].dataType for side in (live, desired)]
    held = [s for s in sides if s["low"] is not None]
    if held and all(isinstance(k, IntegralType) for k in kinds):
        low, high = min(s["low"] for s in held), max(s["high"] for s in held)
        width = max(1, -(-(high - low + 1) // n))
        return F.floor((F.col(key[0]).cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("long")
    return F.pmod(F.xxhash64(*key), F.lit(n))


def differing(live: DataFrame, desired: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The buckets whose digests differ; digests are partial before the shuffle, one row a bucket and task."""
    each = [side.groupBy(*by).agg(*digest(row_hash(columns))).withColumn("side", F.lit(n)) for n, side in enumerate((live, desired))]
    digests = F.struct("rows", "total", "mix")
    met = each[0].unionByName(each[1]).groupBy(*by).agg(F.max(F.when(F.col("side") == 0, digests)).alias("a"), F.max(F.when(F.col("side") == 1, digests)).alias("b"))
    return met.where(~F.col("a").eqNullSafe(F.col("b"))).select(*by)


def suspects(live: DataFrame, desired: DataFrame, key: list[str], compare: list[str], rows: int = RANGE_ROWS, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides whose fine bucket differs."""
    columns, bucket = [*key, *compare], buckets(live, desired, key, rows)
    sides = [side.select(*columns).withColumn("_bucket", bucket) for side in (live, desired)]
    for fine in (False, True):
        by = ["_bucket", "_fine"] if fine else ["_bucket"]
        if fine:
            sides = [side.withColumn("_fine", F.pmod(F.xxhash64(F.lit("fine"), *key), F.lit(split)).cast("int")) for side in sides]
        odd = checkpoint(differing(*sides, by, columns))
        named = odd.select(*[F.col(c).alias(f"{c}_") for c in by])
        same = F.expr(" AND ".join(f"{c} = {c}_" for c in by))
        sides = [side.join(small(named, F.lit(24)), same, "left_semi") for side in sides]
    return sides[0].select(*columns), sides[1].select(*columns)


def digest_diff(live: DataFrame, desired: DataFrame, key: list[str], compare: list[str], rows: int = RANGE_ROWS, split: int = SPLIT) -> DataFrame:
    """(key, change), as row_level_diff gives, from the rows of differing buckets alone."""
    return row_level_diff(*suspects(live, desired, key, compare, rows, split), key, compare)


def checksums(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, rows, total, mix) of the columns' hashes."""
    return df.groupBy(*by).agg(*digest(row_hash(columns)))


def edited_orders(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and orders with one row in a thousand changed, one in two thousand gone and one in two thousand new."""
    live = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority")
    kept = live.where("o_orderkey % 2000 <> 7").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 1000 = 5 THEN NULL ELSE o_orderstatus END"))
    return live, kept.unionByName(live.where("o_orderkey % 2000 = 1").withColumn("o_orderkey", -F.col("o_orderkey") - 1))


def order_digests(spark, sf_dir: str) -> DataFrame:
    live, desired = edited_orders(spark, sf_dir)
    return digest_diff(live, desired, ["o_orderkey"], ["o_orderstatus", "o_custkey", "o_orderpriority"])


def item_digests(spark, sf_dir: str) -> DataFrame:
    """Line items by order, with one flag in five hundred orders changed: a key of two columns, the rows of a key counted together."""
    items = table(spark, sf_dir, "lineitem")
    grouped = lambda flag: items.groupBy("l_orderkey", "l_linestatus").agg(F.count("*").alias("n"), F.max(F.expr(flag)).alias("flag"))
    return digest_diff(grouped("l_returnflag"), grouped("CASE WHEN l_orderkey % 500 = 3 THEN 'Z' ELSE l_returnflag END"), ["l_orderkey", "l_linestatus"], ["n", "flag"])


QUERIES = {"digest_diff": order_digests, "digest_diff_composite": item_digests}

ORACLES = {
    "digest_diff": """
        WITH d AS (
            SELECT o_orderkey, CASE WHEN o_orderkey % 1000 <> 5 THEN o_orderstatus END AS s, o_custkey AS c, o_orderpriority AS p FROM orders WHERE o_orderkey % 2000 <> 7
            UNION ALL SELECT -o_orderkey - 1, o_orderstatus, o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2000 = 1)
        SELECT coalesce(o.o_orderkey, d.o_orderkey) AS o_orderkey,
               CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN d.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM orders o FULL OUTER JOIN d ON o.o_orderkey = d.o_orderkey
        WHERE o.o_orderkey IS NULL OR d.o_orderkey IS NULL OR o.o_orderstatus IS DISTINCT FROM d.s OR o.o_custkey <> d.c OR o.o_orderpriority <> d.p""",
    "digest_diff_composite": """
        SELECT l_orderkey, l_linestatus, 'changed' AS change FROM lineitem WHERE l_orderkey % 500 = 3 GROUP BY ALL""",
}
