"""Metrics of the ledger that are kept by schema, day and status and merged when they are read.

    durations/batch=<name>/   (schema_name, day, status, bucket, n, total): how many records took about so long, and their time together
    plans/batch=<name>/       (schema_name, day, sketch): a theta sketch of the plan hashes

A batch adds the sums of its own records and reads no others; a batch that is written again, whole or after a break, counts once. Any span of days, schemas or statuses is a sum of rows.

A duration d stands in bucket ceil(log(d) / log((1 + ERROR) / (1 - ERROR))); every duration of a bucket is within ERROR of its middle, so a quantile told from buckets is within ERROR of
the record of that rank, however the records were dealt to batches. Merged buckets equal those of one pass. A count of plans is exact up to about NOMINAL different ones, beyond that it
has a relative standard error of about 1 / sqrt(NOMINAL).

Defined cases: a null duration isn't counted, one of 0 or less stands in a bucket of its own and is told as 0; a null plan hash is no plan; null schemas and days are groups of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalpa.operators.ledger import status_of
from catalpa.session import checkpoint, exists, new_folder, remove, table

ERROR = 0.01
GAMMA = (1 + ERROR) / (1 - ERROR)
NOTHING = -(2**31)
LOG_NOMINAL = 12
DURATIONS = "schema_name string, day date, status string, bucket int, n long, total long"
PLANS = "schema_name string, day date, sketch binary"


def bucket(duration: Column) -> Column:
    return F.when(duration <= 0, F.lit(NOTHING)).when(duration > 0, F.ceil(F.log(duration.cast("double")) / F.lit(math.log(GAMMA))).cast("int"))


def middle(place: Column) -> Column:
    """The duration that is within ERROR of all of a bucket."""
    return F.when(place == NOTHING, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), place.cast("double")) * F.lit(2 / (1 + GAMMA)))


def buckets(records: DataFrame) -> DataFrame:
    """Records (schema_name, day, status, duration_ms, plan_hash) summed by bucket."""
    timed = records.where("duration_ms IS NOT NULL").withColumn("bucket", bucket(F.col("duration_ms")))
    return timed.groupBy("schema_name", "day", "status", "bucket").agg(F.count("*").alias("n"), F.sum(F.greatest("duration_ms", F.lit(0))).cast("long").alias("total"))


def plan_sketches(records: DataFrame) -> DataFrame:
    return records.where("plan_hash IS NOT NULL").groupBy("schema_name", "day").agg(F.theta_sketch_agg("plan_hash", LOG_NOMINAL).alias("sketch"))


def append(records: DataFrame, folder: str, batch: str) -> bool:
    """Add a batch; False if it stands there already."""
    spark, places = records.sparkSession, {"durations": buckets, "plans": plan_sketches}
    waiting = [p for p in places if not exists(spark, f"{folder}/{p}/batch={batch}/_SUCCESS")]
    for place in waiting:
        places[place](records).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{place}/batch={batch}")
    return bool(waiting)


def durations(spark: SparkSession, folder: str) -> DataFrame:
    """The buckets of all batches."""
    return spark.read.schema(DURATIONS).parquet(f"{folder}/durations/batch=*") if exists(spark, f"{folder}/durations") else spark.createDataFrame([], DURATIONS)


def plans(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PLANS).parquet(f"{folder}/plans/batch=*") if exists(spark, f"{folder}/plans") else spark.createDataFrame([], PLANS)


def quantiles(summed: DataFrame, by: list[str], percents: tuple[int, ...]) -> DataFrame:
    """(by, records, total, and for each percent p<percent>_bucket and p<percent>) of buckets; the rank of p percent of n records is the least that isn't below it."""
    merged = summed.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    key = by or [F.lit(0)]
    upto = F.sum("n").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # a row for each bucket
    placed = merged.withColumns({"upto": upto, "whole": F.sum("n").over(Window.partitionBy(*key))})
    picks = [F.min(F.when(F.col("upto") >= F.floor((F.col("whole") * p + 99) / 100), F.col("bucket"))).alias(f"p{p}_bucket") for p in percents]
    told = placed.groupBy(*by).agg(F.sum("n").alias("records"), F.sum("total").alias("total"), *picks)
    return told.select(*by, "records", "total", *[c for p in percents for c in (F.col(f"p{p}_bucket"), middle(F.col(f"p{p}_bucket")).alias(f"p{p}"))])


def plan_counts(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, plans): about how many different plans."""
    return sketches.groupBy(*by).agg(F.theta_sketch_estimate(F.theta_union_agg("sketch", LOG_NOMINAL)).alias("plans"))


def timed_ledger(spark, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("schema_name"), F.to_date("ts").alias("day"), status_of(F.col("event_type")).alias("status"), F.floor(F.col("value") * 1000 - 500).cast("long").alias("duration_ms"), F.md5("props").alias("plan_hash"))


def kept_metrics(spark, sf_dir: str) -> str:
    """A folder that four batches were added to, one of them twice."""
    folder, ledger = new_folder(spark, "metrics"), timed_ledger(spark, sf_dir)
    for n in (0, 1, 2, 1, 3):
        append(ledger.where(F.col("event_id") % 4 == n), folder, str(n))
    return folder


def metrics_durations(spark, sf_dir: str) -> DataFrame:
    """Quantiles of durations by schema and status, merged from the batches."""
    folder = kept_metrics(spark, sf_dir)
    told = quantiles(durations(spark, folder), ["schema_name", "status"], (50, 95, 99))
    whole = checkpoint(told.select("schema_name", "status", "records", "total", "p50_bucket", "p95_bucket", "p99_bucket"))
    remove(spark, folder)
    return whole


def metrics_within(spark, sf_dir: str) -> DataFrame:
    """By day, the exact quantiles, and whether those told from buckets are within the error."""
    folder, ledger = kept_metrics(spark, sf_dir), timed_ledger(spark, sf_dir)
    told = quantiles(durations(spark, folder), ["day"], (50, 95))
    ranked = ledger.withColumns({"place": F.row_number().over(Window.partitionBy("day").orderBy("duration_ms")), "whole": F.count("*").over(Window.partitionBy("day"))})
    exact = ranked.groupBy(F.col("day").alias("d")).agg(*[F.min(F.when(F.col("place") >= F.floor((F.col("whole") * p + 99) / 100), F.greatest("duration_ms", F.lit(0)))).alias(f"exact_p{p}") for p in (50, 95)])
    near = lambda p: (F.abs(F.col(f"p{p}") - F.col(f"exact_p{p}")) <= (ERROR + 1e-9) * F.col(f"exact_p{p}")).alias(f"p{p}_within")
    whole = checkpoint(told.join(exact, F.expr("day <=> d")).select(F.col("day").cast("string").alias("day"), "records", "exact_p50", "exact_p95", near(50), near(95)))
    remove(spark, folder)
    return whole


def metrics_plans(spark, sf_dir: str) -> DataFrame:
    """Different plans by schema over all days."""
    folder = kept_metrics(spark, sf_dir)
    whole = checkpoint(plan_counts(plans(spark, folder), ["schema_name"]))
    remove(spark, folder)
    return whole


QUERIES = {f.__name__: f for f in (metrics_durations, metrics_within, metrics_plans)}

TIMED = """WITH l AS (SELECT 's' || CAST(user_id % 50 AS VARCHAR) AS schema_name, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(floor(value * 1000 - 500) AS BIGINT) AS d, md5(props) AS plan_hash,
        CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'signup' THEN 'baseline' WHEN 'view' THEN 'partial' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'resolved' END AS status FROM events)"""
PLACED = """, r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY d) AS place, count(*) OVER (PARTITION BY {by}) AS n FROM l)"""
RANK = "min(greatest(d, 0)) FILTER (WHERE place >= (n * {p} + 99) // 100)"
BUCKET = f"CAST(CASE WHEN {RANK} = 0 THEN {NOTHING} ELSE ceil(ln(greatest(1, {RANK})) / ln(1.01 / 0.99)) END AS INTEGER) AS p{{p}}_bucket"
ORACLES = {
    "metrics_durations": TIMED + PLACED.format(by="schema_name, status") + " SELECT schema_name, status, count(*) AS records, CAST(sum(greatest(d, 0)) AS BIGINT) AS total, " + ", ".join(BUCKET.format(p=p) for p in (50, 95, 99)) + " FROM r GROUP BY schema_name, status",
    "metrics_within": TIMED + PLACED.format(by="day") + f" SELECT day, count(*) AS records, {RANK.format(p=50)} AS exact_p50, {RANK.format(p=95)} AS exact_p95, true AS p50_within, true AS p95_within FROM r GROUP BY day",
    "metrics_plans": TIMED + " SELECT schema_name, count(DISTINCT plan_hash) AS plans FROM l GROUP BY schema_name",
}
