"""Partitions as rows: routing rows to many range or hash partitions, and finding bounds that overlap or leave gaps.

Bounds are rows (parent, part, low, high): half-open ranges [low, high), a null low or high is open. Values may be of any type that has an order,
also structs. Ranges that hold nothing (low >= high) take no rows and no part in the sweep.

Routing is an equality join on a bucket, so no expression grows with the number of partitions: edges cut the bounds into at most BUCKETS runs, a
row finds its bucket by halving, and each bound stands in the buckets it reaches into. Where the bounds are small they are broadcast and the rows
aren't shuffled. A row without a value, or in a gap, has no partition; where bounds overlap, a row stands once for each partition that takes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from catalpa.session import checkpoint, small, table

BUCKETS = 256
#: So many edges are met by tests that Spark compiles, more by a loop over an array.
FEW = 16


def literal(value) -> Column:
    """A constant; a row becomes a struct."""
    return F.struct(*[literal(x).alias(n) for n, x in value.asDict(recursive=False).items()]) if isinstance(value, Row) else F.lit(value)


def holding(bounds: DataFrame) -> DataFrame:
    """The bounds that can hold a row."""
    return bounds.where("low IS NULL OR high IS NULL OR low < high")


def edges_of(bounds: DataFrame, buckets: int) -> list:
    """At most so many values that cut the bounds' lows into runs of about equal length, in order."""
    cut = bounds.where("low IS NOT NULL").select("low").repartitionByRange(buckets, "low").groupBy(F.spark_partition_id()).agg(F.min("low").alias("low"))
    return [r["low"] for r in cut.select("low").distinct().orderBy("low").collect()]  # buckets rows at most


def bucket(value: Column, edges: list, kind: DataType, reached: bool = True) -> Column:
    """How many edges are at or below the value (below it, where reached is false), by halving."""
    if not edges:
        return F.lit(0)
    below = lambda edge: edge <= value if reached else edge < value
    if len(edges) <= FEW:

        def halve(low: int, high: int) -> Column:
            at = (low + high) // 2
            return F.lit(low) if low == high else F.when(below(literal(edges[at]).cast(kind)), halve(at + 1, high)).otherwise(halve(low, at))

        return halve(0, len(edges))
    held = F.array(*[literal(e) for e in edges]).cast(ArrayType(kind))
    steps = F.array(*[F.lit(2**k) for k in reversed(range(len(edges).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(F.get(held, at + step - 1)), at + step).otherwise(at))


def route(df: DataFrame, value: Column, bounds: DataFrame, part: str = "part", how: str = "left") -> DataFrame:
    """df with the partition, from bounds (part, low, high), that holds its value."""
    kept = checkpoint(holding(bounds).select(F.col("part").alias(part), F.col("low").alias("__low"), F.col("high").alias("__high")))
    kind = kept.schema["__low"].dataType
    edges = edges_of(kept.select(F.col("__low").alias("low")), BUCKETS)
    first = F.when(F.col("__low").isNull(), F.lit(0)).otherwise(bucket(F.col("__low"), edges, kind))
    last = F.when(F.col("__high").isNull(), F.lit(len(edges))).otherwise(bucket(F.col("__high"), edges, kind, reached=False))
    dealt = checkpoint(kept.withColumn("__b", F.explode(F.sequence(first, last))))
    placed = df.withColumn("__value", value.cast(kind)).withColumn("__bucket", F.coalesce(F.when(F.col("__value").isNotNull(), bucket(F.col("__value"), edges, kind)), F.lit(-1)))  # never null, so no filter tells it a second time
    inside = "__bucket = __b AND (__low IS NULL OR __value >= __low) AND (__high IS NULL OR __value < __high)"
    joined = placed.join(small(dealt, 48 + 2 * F.length(F.to_json(F.struct("__low")))), F.expr(inside), how)
    return joined.drop("__value", "__bucket", "__b", "__low", "__high")


def sweep(bounds: DataFrame, slices: int | None = None) -> DataFrame:
    """(parent, part, low, high, before): before is, of the ranges of a parent that start earlier, the one that reaches furthest, as (hi, part).

    The line is cut by ranges of (parent, low), so that no task holds all bounds of a parent; what earlier pieces reach is carried over.
    """
    slices = slices or int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lo = F.struct(F.col("low").isNotNull().alias("from"), F.col("low").alias("at"))
    hi = F.struct(F.col("high").isNull().alias("open"), F.col("high").alias("at"))
    sized = holding(bounds).select("parent", "part", "low", "high", lo.alias("lo"), F.struct(hi.alias("hi"), F.col("part").alias("part")).alias("reach"))
    placed = checkpoint(sized.repartitionByRange(slices, "parent", "lo", "part").withColumn("slice", F.spark_partition_id()))
    ends = placed.groupBy("slice", "parent").agg(F.max("reach").alias("own"))  # a row for each slice and parent in it
    carried = ends.withColumn("carried", F.max("own").over(Window.partitionBy("parent").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).drop("own")
    ahead = F.max("reach").over(Window.partitionBy("slice", "parent").orderBy("lo", "part").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("ahead", ahead).join(carried, ["slice", "parent"]).select("parent", "part", "low", "high", F.greatest("ahead", "carried").alias("before"))


def overlaps(bounds: DataFrame) -> DataFrame:
    """(parent, part, other): ranges that start before an earlier one of their parent, the one that reaches furthest, has ended."""
    hit = sweep(bounds).where("before IS NOT NULL AND (low IS NULL OR before.hi.open OR low < before.hi.at)")
    return hit.select("parent", "part", F.col("before.part").alias("other"))


def gaps(bounds: DataFrame) -> DataFrame:
    """(parent, low, high): values between ranges of a parent that none of them holds."""
    return sweep(bounds).where("before IS NOT NULL AND NOT before.hi.open AND low > before.hi.at").select("parent", F.col("before.hi.at").alias("low"), F.col("low").alias("high"))


def claims(parts: DataFrame) -> DataFrame:
    """(parent, part, top, claim) of hash partitions (parent, part, modulus, remainder): every remainder of the parent's largest modulus that a part takes."""
    tops = parts.groupBy(F.col("parent").alias("p")).agg(F.max("modulus").alias("top"))
    each = parts.join(tops, F.expr("parent <=> p")).where("top % modulus = 0 AND remainder BETWEEN 0 AND modulus - 1")
    return each.select("parent", "part", "top", F.explode(F.expr("sequence(remainder, top - 1, modulus)")).alias("claim"))


def misclaimed(parts: DataFrame) -> DataFrame:
    """(parent, claim, parts): remainders of the largest modulus that no partition takes, or more than one."""
    found = claims(parts)
    every = parts.groupBy("parent").agg(F.max("modulus").alias("top")).select("parent", F.explode(F.expr("sequence(0, top - 1)")).alias("claim"))
    counts = found.groupBy(F.col("parent").alias("p"), F.col("claim").alias("c")).agg(F.count("*").alias("parts"))
    return every.join(counts, F.expr("parent <=> p AND claim = c"), "left").select("parent", "claim", F.coalesce("parts", F.lit(0)).alias("parts")).where("parts <> 1")


def route_hash(df: DataFrame, hashed: Column, parts: DataFrame, part: str = "part") -> DataFrame:
    """df with the hash partition, of one parent's, whose modulus and remainder fit the hash."""
    held = checkpoint(claims(parts).select(F.col("part").alias(part), F.col("top").alias("__top"), F.col("claim").alias("__claim")))
    top = held.agg(F.max("__top")).first()[0]
    placed = df.withColumn("__rest", F.pmod(hashed, F.lit(top)) if top else F.lit(None).cast("long"))
    return placed.join(small(held, F.lit(48)), F.expr("__rest = __claim"), "left").drop("__rest", "__top", "__claim")


def key_ranges(spark, sf_dir: str) -> DataFrame:
    """A partition of orders for every part: seven keys, but five or none where the key ends a row of five or seven, the first and last one open."""
    ends = "CASE WHEN p_partkey = (SELECT max(p_partkey) FROM part) THEN NULL WHEN p_partkey % 7 = 0 THEN 7 * p_partkey - 7 WHEN p_partkey % 5 = 0 THEN 7 * p_partkey - 2 ELSE 7 * p_partkey END"
    part = table(spark, sf_dir, "part")
    last = part.agg(F.max("p_partkey").alias("last"))
    high = F.expr(ends.replace("(SELECT max(p_partkey) FROM part)", "last"))
    return part.crossJoin(F.broadcast(last)).select(F.concat(F.lit("p"), "p_partkey").alias("part"), F.when(F.col("p_partkey") > 1, 7 * F.col("p_partkey") - 7).alias("low"), high.alias("high"))


def partition_intervals(spark, sf_dir: str) -> DataFrame:
    """Orders in each of as many partitions as there are parts, and outside of all."""
    routed = route(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey"), key_ranges(spark, sf_dir))
    return routed.groupBy("part").agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def brand_ranges(spark, sf_dir: str) -> DataFrame:
    """Ranges of each brand, one a part, as long as the part's size; some are open, some hold nothing."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("parent"), F.concat(F.lit("p"), "p_partkey").alias("part"), F.expr("CASE WHEN p_partkey % 97 <> 0 THEN 2 * p_partkey END").alias("low"), F.expr("CASE WHEN p_partkey % 89 <> 0 THEN 2 * p_partkey + p_size - 2 END").alias("high"))


def partition_overlaps(spark, sf_dir: str) -> DataFrame:
    return overlaps(brand_ranges(spark, sf_dir))


def partition_gaps(spark, sf_dir: str) -> DataFrame:
    return gaps(brand_ranges(spark, sf_dir))


HASH_PARTS = [("h0", 4, 0), ("h1", 4, 1), ("h2", 8, 2), ("h2_again", 16, 10), ("h2_late", 8, 6), ("h3", 8, 3)]


def hash_parts(spark) -> DataFrame:
    return spark.createDataFrame([("events", *p) for p in HASH_PARTS], "parent string, part string, modulus int, remainder int")


def partition_hashes(spark, sf_dir: str) -> DataFrame:
    """Events by user, in hash partitions of several moduli; 7, 15 are nobody's, the second half of 2 is."""
    routed = route_hash(table(spark, sf_dir, "events").select("user_id", "event_id"), F.col("user_id"), hash_parts(spark))
    return routed.groupBy("part").agg(F.count("*").alias("rows"), F.sum("event_id").alias("events"))


QUERIES = {f.__name__: f for f in (partition_intervals, partition_overlaps, partition_gaps, partition_hashes)}

RANGES = "SELECT p_brand AS parent, 'p' || p_partkey AS part, CASE WHEN p_partkey % 97 <> 0 THEN 2 * p_partkey END AS low, CASE WHEN p_partkey % 89 <> 0 THEN 2 * p_partkey + p_size - 2 END AS high FROM part"
SWEPT = f"""
        WITH r AS (SELECT *, coalesce(low, -1000000000000) AS l, coalesce(high, 1000000000000) AS h FROM ({RANGES}) WHERE low IS NULL OR high IS NULL OR low < high),
        s AS (SELECT *, max({{'h': h, 'part': part}}) OVER (PARTITION BY parent ORDER BY l, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)"""
ORACLES = {
    "partition_intervals": """
        WITH b AS (
            SELECT 'p' || p_partkey AS part, CASE WHEN p_partkey > 1 THEN 7 * p_partkey - 7 ELSE -1 END AS low,
                   CASE WHEN p_partkey = (SELECT max(p_partkey) FROM part) THEN 1000000000000 WHEN p_partkey % 7 = 0 THEN 7 * p_partkey - 7 WHEN p_partkey % 5 = 0 THEN 7 * p_partkey - 2 ELSE 7 * p_partkey END AS high FROM part)
        SELECT part, count(*) AS rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders LEFT JOIN b ON o_orderkey >= low AND o_orderkey < high GROUP BY part""",
    "partition_overlaps": SWEPT + " SELECT parent, part, before.part AS other FROM s WHERE l < before.h",
    "partition_gaps": SWEPT + " SELECT parent, before.h AS low, l AS high FROM s WHERE l > before.h",
    "partition_hashes": f"""
        WITH p AS (SELECT * FROM (VALUES {", ".join(map(str, HASH_PARTS))}) AS t(part, modulus, remainder))
        SELECT part, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS events FROM events LEFT JOIN p ON user_id % modulus = remainder GROUP BY part""",
}
