"""Seeds that may conflict through any of several unique keys, as if inserted one after another in a stated order.

A seed row that shares no key with the target or with a seed row inserted before it is inserted. One that meets a single row updates it, the last by order wins; one that meets two
rows or more is refused, for there is no one row it could be.

Rows are not taken one after another: a seed row that is the first, by order, at each of its keys among those still open is inserted, all such rows at once; then all that
share a key with a row that stands are settled. This gives what the sequence gives, since a row's fate depends on earlier rows of its keys alone. The number of rounds is that of the longest chain of
rows each waiting for the one before, in the stated order a few for most seeds.

Defined cases: a key that holds a null conflicts with nothing; a row all of whose keys do is inserted. Equal rows are taken in any order, the first is inserted, the others update it.
Update columns must not be part of a key. Keys of the target are taken to be unique.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalpa.session import checkpoint, table


def claims(keys: list[list[str]]) -> Column:
    """What a row holds of each unique key, as text, but for keys with a null."""
    held = []
    for n, key in enumerate(keys):
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
        held.append(F.when(whole, F.to_json(F.struct(F.lit(n).alias("k"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(key)]))))
    return F.array_compact(F.array(*held))


def resolved(target: DataFrame, seed: DataFrame, keys: list[list[str]], order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the target (__id, columns), rows of the seed (__id, __place, columns) and fates (__id, owner): a seed row's owners are the rows it meets; itself, if it is inserted."""
    rows = checkpoint(target.withColumn("__id", F.concat(F.lit("t"), F.monotonically_increasing_id().cast("string"))))
    columns = target.columns
    place = F.struct(*order, F.to_json(F.struct(*columns)).alias("__row"), F.col("__id"))
    typed = seed.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in columns], *[c for c in order if c not in columns])
    seeds = checkpoint(typed.withColumn("__id", F.concat(F.lit("s"), F.monotonically_increasing_id().cast("string"))).withColumn("__place", place))
    held = checkpoint(rows.select(F.explode(claims(keys)).alias("claim"), F.col("__id").alias("owner"), F.lit(None).cast(seeds.schema["__place"].dataType).alias("since")))
    each = checkpoint(seeds.select("__id", "__place", F.explode_outer(claims(keys)).alias("claim")))
    own = checkpoint(each.where("claim IS NULL").select("__id").distinct())  # nothing to conflict with
    waiting = each.where("claim IS NOT NULL")
    while True:
        hit = waiting.join(held.select("claim").distinct(), "claim", "left_semi").select("__id").distinct()
        waiting = checkpoint(waiting.join(hit, "__id", "left_anti"))
        if waiting.isEmpty():
            break
        first = waiting.groupBy("claim").agg(F.min("__place").alias("first"))
        told = waiting.join(first, "claim").groupBy("__id").agg(F.bool_and(F.col("__place") == F.col("first")).alias("leads"))
        leads = checkpoint(told.where("leads").select("__id"))
        own = checkpoint(own.unionByName(leads))
        held = checkpoint(held.unionByName(waiting.join(leads, "__id", "left_semi").select("claim", F.col("__id").alias("owner"), F.col("__place").alias("since"))))
    met = each.join(own, "__id", "left_anti").join(held, "claim").where("since IS NULL OR since < __place").select("__id", "owner").distinct()
    return rows, seeds, checkpoint(met.unionByName(own.select("__id", F.col("__id").alias("owner"))))


def outcomes(target: DataFrame, seed: DataFrame, keys: list[list[str]], order: list[str]) -> DataFrame:
    """The seed's rows with what becomes of each: inserted, met (one row) or refused (several)."""
    _, seeds, fates = resolved(target, seed, keys, order)
    told = fates.groupBy("__id").agg(F.count("*").alias("n"), F.bool_or(F.col("__id") == F.col("owner")).alias("own"))
    fate = F.when(F.col("own"), "inserted").when(F.col("n") == 1, "met").otherwise("refused")
    return seeds.join(told, "__id").withColumn("outcome", fate).drop("__id", "__place", "n", "own")


def insert_ignore(target: DataFrame, seed: DataFrame, keys: list[list[str]], order: list[str]) -> DataFrame:
    """The target with the seed rows that conflict with nothing."""
    rows, seeds, fates = resolved(target, seed, keys, order)
    return rows.select(*target.columns).unionByName(seeds.join(fates.where("__id = owner"), "__id", "left_semi").select(*target.columns))


def upsert(target: DataFrame, seed: DataFrame, keys: list[list[str]], update: list[str], order: list[str]) -> DataFrame:
    """The target with new seed rows, and with the update columns of the last seed row that meets it alone."""
    rows, seeds, fates = resolved(target, seed, keys, order)
    alone = fates.groupBy("__id").agg(F.count("*").alias("n"), F.min("owner").alias("owner")).where("n = 1 AND owner <> __id")
    last = seeds.join(alone, "__id").groupBy(F.col("owner").alias("__owner")).agg(F.max_by(F.struct(*update), "__place").alias("__new"))
    stand = rows.unionByName(seeds.join(fates.where("__id = owner"), "__id", "left_semi").select(*rows.columns))
    out = stand.join(last, F.col("__id") == F.col("__owner"), "left")
    return out.select(*[F.when(F.col("__owner").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in target.columns])


#: Thirty customers are a group; each third one stands, the others are seeds, both with two keys of the group's.
GROUPED = """SELECT c_custkey AS c, c_custkey // 30 AS g, CASE WHEN c_custkey % 11 = 0 AND c_custkey % 3 > 0 THEN NULL WHEN c_custkey % 3 = 0 THEN c_custkey % 30 // 3 ELSE c_nationkey % 22 END AS a,
    CASE WHEN c_custkey % 13 = 0 AND c_custkey % 3 > 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 2 * (c_custkey % 30 // 3) ELSE c_custkey * 7 % 30 END AS b, c_name AS v FROM {customer}"""


def grouped(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = spark.sql(GROUPED.replace("//", "div"), customer=table(spark, sf_dir, "customer"))
    every = every.select("c", *[F.col(x).cast("long").alias(x) for x in "gab"], "v")
    return every.where("c % 3 = 0"), every.where("c % 3 > 0")


def conflict_outcomes(spark, sf_dir: str) -> DataFrame:
    target, seed = grouped(spark, sf_dir)
    return outcomes(target, seed, [["g", "a"], ["g", "b"]], ["c"]).select("c", "outcome")


def conflict_upsert(spark, sf_dir: str) -> DataFrame:
    target, seed = grouped(spark, sf_dir)
    return upsert(target, seed, [["g", "a"], ["g", "b"]], ["v"], ["c"]).select("c", "v")


QUERIES = {f.__name__: f for f in (conflict_outcomes, conflict_upsert)}

STEPPED = f"""
        WITH RECURSIVE e AS MATERIALIZED ({GROUPED.replace("{customer}", "customer")}),
        s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c) AS n FROM e WHERE c % 3 > 0),
        r AS (
            SELECT g, CAST(0 AS BIGINT) AS n, list({{'c': c, 'a': a, 'b': b}}) FILTER (WHERE c % 3 = 0) AS state, CAST(NULL AS BIGINT) AS c, CAST([] AS BIGINT[]) AS hits FROM e GROUP BY g
            UNION ALL SELECT r.g, s.n, CASE WHEN len(own) = 0 THEN list_append(coalesce(r.state, []), {{'c': s.c, 'a': s.a, 'b': s.b}}) ELSE r.state END, s.c, list_transform(own, lambda x: x.c)
            FROM r JOIN s ON s.g = r.g AND s.n = r.n + 1, LATERAL (SELECT list_filter(coalesce(r.state, []), lambda x: x.a = s.a OR x.b = s.b) AS own))"""
ORACLES = {
    "conflict_outcomes": STEPPED + " SELECT c, CASE len(hits) WHEN 0 THEN 'inserted' WHEN 1 THEN 'met' ELSE 'refused' END AS outcome FROM r WHERE c IS NOT NULL",
    "conflict_upsert": STEPPED + """, u AS (SELECT hits[1] AS c, max_by(e.v, r.c) AS v FROM r JOIN e ON e.c = r.c WHERE len(hits) = 1 GROUP BY hits[1])
        SELECT e.c, coalesce(u.v, e.v) AS v FROM e LEFT JOIN u USING (c) WHERE e.c % 3 = 0 OR e.c IN (SELECT c FROM r WHERE len(hits) = 0)""",
}
