"""The ledger of migrations: an append-only table, asked for counts, latest records, readiness and repairs.

Records: id, schema_name, plan_hash, status, failed_step, error, applied_at, duration_ms, seed_hash, schema_hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalpa.session import table

#: The statuses a record can have, and those that count as applied in a summary or make a schema ready.
STATUSES = ("applied", "baseline", "failed", "partial", "resolved")
COUNT_AS_APPLIED = ("applied", "baseline", "resolved")
READY = ("applied", "baseline")


def status_counts(ledger: DataFrame) -> DataFrame:
    """(applied, partial, failed, other, total)."""
    by = ledger.groupBy("status").agg(F.count("*").alias("n"))
    pick = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    status = F.col("status")
    return by.agg(
        pick(status.isin(*COUNT_AS_APPLIED)).alias("applied"),
        pick(status == "partial").alias("partial"),
        pick(status == "failed").alias("failed"),
        pick(~status.isin(*COUNT_AS_APPLIED, "partial", "failed") | status.isNull()).alias("other"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )


def latest(ledger: DataFrame, by: list[str]) -> DataFrame:
    """The record with the highest id of each group, by one partial aggregate."""
    rest = [c for c in ledger.columns if c not in by]
    return ledger.groupBy(*by).agg(F.max_by(F.struct(*rest), "id").alias("r")).select(*by, "r.*")


def entries(ledger: DataFrame, size: int, newest_first: bool = True) -> DataFrame:
    return ledger.orderBy(F.col("id").desc() if newest_first else F.col("id").asc()).limit(size)


def applied_hashes(plans: DataFrame, ledger: DataFrame, column: str = "plan_hash") -> DataFrame:
    """plans with whether a record of that hash has been applied."""
    done = ledger.where(F.col("status").isin(*READY) & F.col(column).isNotNull()).select(F.col(column).alias("__done")).distinct()
    return plans.join(done, F.col(column) == F.col("__done"), "left").withColumn("is_applied", F.col("__done").isNotNull()).drop("__done")


def ready(ledger: DataFrame, wanted: DataFrame) -> DataFrame:
    """(schema_name, is_ready, all_ready): the latest record of a wanted (schema_name, schema_hash) is applied with that hash."""
    last = latest(ledger, ["schema_name"]).select("schema_name", "status", F.col("schema_hash").alias("have"))
    each = wanted.join(last, "schema_name", "left").select("schema_name", F.coalesce(F.col("status").isin(*READY) & (F.col("have") == F.col("schema_hash")), F.lit(False)).alias("is_ready"))
    every = each.groupBy(F.lit(1).alias("one")).agg(F.bool_and("is_ready").alias("all_ready"))
    return each.withColumn("one", F.lit(1)).join(F.broadcast(every), "one").drop("one")  # every is one row


def repaired(ledger: DataFrame, note: str) -> DataFrame:
    """The ledger with the latest record of a schema set to resolved, with a note, if it is partial or failed."""
    last = latest(ledger, ["schema_name"]).where(F.col("status").isin("partial", "failed")).select(F.col("id").alias("__id"))
    mark = F.col("__id").isNotNull()
    joined = ledger.join(last, F.col("id") == F.col("__id"), "left")
    return joined.withColumns({"status": F.when(mark, "resolved").otherwise(F.col("status")), "error": F.when(mark, F.concat(F.coalesce("error", F.lit("")), F.lit(note))).otherwise(F.col("error"))}).drop("__id")


def by_id(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the ids asked for; an id without a record has no row."""
    return ledger.join(ids, "id", "left_semi")


def with_baseline(ledger: DataFrame, wanted: DataFrame, note: str) -> DataFrame:
    """The ledger with a baseline record for each wanted (schema_name, plan_hash, schema_hash) that has no record yet; ids go on after the last.

    The new ids follow the names of the schemas; a schema has one row in wanted.
    """
    last = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = wanted.join(ledger.select("schema_name").distinct(), "schema_name", "left_anti")
    numbered = new.withColumn("n", F.row_number().over(Window.orderBy("schema_name")))  # one row a schema without a record
    rows = numbered.join(F.broadcast(last)).withColumn("id", F.col("last") + F.col("n"))  # last is one row
    given = {"status": F.lit("baseline"), "error": F.lit(note)}
    return ledger.unionByName(rows.select(*[given[c].alias(c) if c in given else F.col(c) if c in ("id", *wanted.columns) else F.lit(None).cast(ledger.schema[c].dataType).alias(c) for c in ledger.columns]))


def status_report(ledger: DataFrame, open_steps: DataFrame) -> DataFrame:
    """(schema_name, applied, partial, failed, latest_id, latest_status, pending, in_sync) of each schema that has records or open steps (schema_name, a row each); without records id 0 and no status."""
    fold = lambda *names: F.count_if(F.col("status").isin(*names))
    counts = ledger.groupBy("schema_name").agg(fold(*COUNT_AS_APPLIED).alias("applied"), fold("partial").alias("partial"), fold("failed").alias("failed"), F.max("id").alias("latest_id"), F.max_by("status", "id").alias("latest_status"))
    pending = open_steps.groupBy("schema_name").agg(F.count("*").alias("pending"))
    zero = F.lit(0)
    joined = counts.join(pending, "schema_name", "full_outer")
    return joined.select("schema_name", *[F.coalesce(c, zero).alias(c) for c in ("applied", "partial", "failed", "latest_id")], F.coalesce("latest_status", F.lit("")).alias("latest_status"), F.coalesce("pending", zero).alias("pending"), (F.coalesce("pending", zero) == 0).alias("in_sync"))


def step_groups(steps: DataFrame, partition: str = "plan_id") -> DataFrame:
    """steps with grp: a new one where non_tx changes, on a validation, or after one."""
    w = Window.partitionBy(partition).orderBy("idx")
    validates = F.col("change_type") == "VALIDATE_CONSTRAINT"
    starts = F.lag("idx").over(w).isNull() | (F.lag("non_tx").over(w) != F.col("non_tx")) | validates | F.coalesce(F.lag(validates).over(w), F.lit(False))
    return steps.withColumn("starts", starts.cast("int")).withColumn("grp", F.sum("starts").over(w)).drop("starts")


def status_of(event_type: Column) -> Column:
    """Events as a ledger: each type stands for a status."""
    named = F.create_map(*[F.lit(x) for pair in (("purchase", "applied"), ("signup", "baseline"), ("view", "partial"), ("error", "failed"), ("click", "resolved")) for x in pair])
    return named[event_type]


def event_ledger(spark, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("id"), F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("schema_name"), status_of(F.col("event_type")).alias("status"), F.sha2(F.trim(F.col("props")), 256).alias("schema_hash"), F.lit(None).cast("string").alias("error"), F.md5(F.col("props")).alias("plan_hash"))


def ledger_summary(spark, sf_dir: str) -> DataFrame:
    return status_counts(event_ledger(spark, sf_dir))


def ledger_latest(spark, sf_dir: str) -> DataFrame:
    return latest(event_ledger(spark, sf_dir), ["schema_name"]).select("schema_name", "id", "status", "schema_hash")


def ledger_entries(spark, sf_dir: str) -> DataFrame:
    return entries(event_ledger(spark, sf_dir), 25).select("id", "schema_name", "status")


def ledger_ready(spark, sf_dir: str) -> DataFrame:
    ledger = event_ledger(spark, sf_dir)
    wanted = ledger.where("status IN ('applied', 'baseline')").groupBy("schema_name").agg(F.max_by("schema_hash", "id").alias("schema_hash"))
    return ready(ledger, wanted)


def ledger_repair(spark, sf_dir: str) -> DataFrame:
    return repaired(event_ledger(spark, sf_dir), " resolved by hand").groupBy("schema_name", "status").agg(F.count("*").alias("records"), F.count("error").alias("notes"))


def ledger_applied(spark, sf_dir: str) -> DataFrame:
    ledger = event_ledger(spark, sf_dir)
    plans = ledger.select("plan_hash").distinct()
    return applied_hashes(plans, ledger).groupBy("is_applied").agg(F.count("*").alias("plans"))


def ledger_by_id(spark, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("id"))
    return by_id(event_ledger(spark, sf_dir), wanted).select("id", "schema_name", "status")


def ledger_baseline(spark, sf_dir: str) -> DataFrame:
    """Baselines for schemas that the ledger of the first schemas doesn't know."""
    ledger = event_ledger(spark, sf_dir)
    wanted = ledger.groupBy("schema_name").agg(F.min("plan_hash").alias("plan_hash"), F.max("schema_hash").alias("schema_hash"))
    return with_baseline(ledger.where("schema_name < 's3'"), wanted, "taken over").where("status = 'baseline'").select("id", "schema_name", "plan_hash", "error")


def ledger_status(spark, sf_dir: str) -> DataFrame:
    from catalpa.plans import generated

    return status_report(event_ledger(spark, sf_dir), generated.frame(spark, sf_dir, "open_work"))


QUERIES = {f.__name__: f for f in (ledger_summary, ledger_latest, ledger_entries, ledger_ready, ledger_repair, ledger_applied, ledger_by_id, ledger_baseline, ledger_status)}

LEDGER = """WITH l AS (SELECT event_id AS id, 's' || CAST(user_id % 50 AS VARCHAR) AS schema_name,
        CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'signup' THEN 'baseline' WHEN 'view' THEN 'partial' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'resolved' END AS status,
        sha256(trim(props)) AS schema_hash, md5(props) AS plan_hash FROM events),
    last AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY schema_name ORDER BY id DESC) = 1) """
ORACLES = {
    "ledger_summary": LEDGER + """SELECT count(*) FILTER (WHERE status IN ('applied', 'baseline', 'resolved')) AS applied, count(*) FILTER (WHERE status = 'partial') AS partial,
        count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status IS NULL) AS other, count(*) AS total FROM l""",
    "ledger_latest": LEDGER + "SELECT schema_name, id, status, schema_hash FROM last",
    "ledger_entries": LEDGER + "SELECT id, schema_name, status FROM l ORDER BY id DESC LIMIT 25",
    "ledger_ready": LEDGER + """, wanted AS (SELECT schema_name, schema_hash FROM l WHERE status IN ('applied', 'baseline') QUALIFY row_number() OVER (PARTITION BY schema_name ORDER BY id DESC) = 1),
        each AS (SELECT schema_name, coalesce(last.status IN ('applied', 'baseline') AND last.schema_hash = wanted.schema_hash, false) AS is_ready FROM wanted LEFT JOIN last USING (schema_name))
        SELECT schema_name, is_ready, (SELECT bool_and(is_ready) FROM each) AS all_ready FROM each""",
    "ledger_repair": LEDGER + """SELECT l.schema_name, CASE WHEN last.id IS NOT NULL THEN 'resolved' ELSE l.status END AS status, count(*) AS records, count(last.id) AS notes
        FROM l LEFT JOIN last ON l.id = last.id AND last.status IN ('partial', 'failed') GROUP BY ALL""",
    "ledger_applied": LEDGER + "SELECT is_applied, count(*) AS plans FROM (SELECT plan_hash, bool_or(status IN ('applied', 'baseline')) AS is_applied FROM l GROUP BY plan_hash) GROUP BY is_applied",
    "ledger_by_id": LEDGER + "SELECT id, schema_name, status FROM l WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 = 0)",
    "ledger_baseline": LEDGER + """, some AS MATERIALIZED (SELECT * FROM l WHERE schema_name < 's3'), n AS (SELECT schema_name, min(plan_hash) AS plan_hash FROM l WHERE schema_name NOT IN (SELECT schema_name FROM some) GROUP BY schema_name)
        SELECT id, schema_name, plan_hash, NULL AS error FROM some WHERE status = 'baseline'
        UNION ALL SELECT (SELECT max(id) FROM some) + row_number() OVER (ORDER BY schema_name), schema_name, plan_hash, 'taken over' FROM n""".replace("some", "known_rows"),
    "ledger_status": LEDGER + """, o AS (SELECT 's' || CAST(o_custkey % 60 AS VARCHAR) AS schema_name, count(*) AS pending FROM orders WHERE o_custkey % 60 < 40 GROUP BY 1),
        c AS (SELECT schema_name, count(*) FILTER (WHERE status IN ('applied', 'baseline', 'resolved')) AS applied, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'failed') AS failed FROM l GROUP BY schema_name)
        SELECT schema_name, coalesce(applied, 0) AS applied, coalesce(partial, 0) AS partial, coalesce(failed, 0) AS failed, coalesce(last.id, 0) AS latest_id, coalesce(last.status, '') AS latest_status, coalesce(pending, 0) AS pending, pending IS NULL AS in_sync
        FROM c FULL OUTER JOIN o USING (schema_name) LEFT JOIN last USING (schema_name)""",
}
