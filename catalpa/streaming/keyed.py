"""Drift by column as keyed state: a stream of observations, the last place and status of each column, and only what changes is told.

An observation (sch, tbl, col, seen, gone, data_type, nullable) says how a column was, or that it was gone, at the place `seen` of its history. Spark compares it with
the desired columns, a static side of the stream; the state store keeps each column's last place and status in step with the stream's checkpoint, so a restart goes on where the
last finished batch ended and the files of the sink hold each change once. Columns share PACKS rows of state by their hash, so that a batch calls Python once for each pack that it observes,
however many columns there are; a pack's row is written anew when one of its columns is observed. PACKS belongs to a checkpoint and must not change under it.

Defined cases: an observation at or before the column's last place, late or repeated, changes nothing. Several of one batch are taken in their order. A column nobody has observed has no
state. An observation without a place changes nothing. Types are compared in their normal form, a null nullable equals another. Desired rows of one column must be unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from catalpa.functions import sqltypes
from catalpa.plans import generated
from catalpa.session import checkpoint, new_folder, remove, table

KEY = ["sch", "tbl", "col"]
OBSERVED = "sch string, tbl string, col string, seen long, gone boolean, data_type string, nullable boolean"
CHANGES = "sch string, tbl string, col string, seen long, was string, now string"
STATE = "sch array<string>, tbl array<string>, col array<string>, seen array<long>, status array<string>"
UNKNOWN = "unknown"
PACKS = 2048


def status() -> Column:
    """What an observation beside its desired column (want_type, want_nullable, wanted) comes to."""
    wanted = F.coalesce("wanted", F.lit(False))
    same = sqltypes.normalize_type(F.col("data_type")).eqNullSafe(sqltypes.normalize_type(F.col("want_type"))) & F.col("nullable").eqNullSafe(F.col("want_nullable"))
    return F.when(F.col("gone"), F.when(wanted, "missing").otherwise("in sync")).when(~wanted, "surplus").when(same, "in sync").otherwise("differs")


def follow(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes of the status of a pack's columns, and their new state."""
    held = {tuple(key): last for *key, last in zip(*state.get[:3], zip(*state.get[3:]))} if state.exists else {}
    rows, out = pd.concat(frames).sort_values("seen"), []
    for *key, at, found in zip(*[rows[c].tolist() for c in (*KEY, "seen", "now")]):
        seen, now = held.get(tuple(key), (None, UNKNOWN))
        if seen is None or at > seen:
            if found != now:
                out.append((*key, at, now, found))
            held[tuple(key)] = (at, found)
    state.update(tuple(map(list, zip(*[(*key, *last) for key, last in held.items()]))))
    yield pd.DataFrame(out, columns=[*KEY, "seen", "was", "now"])


def transitions(observed: DataFrame, desired: DataFrame) -> DataFrame:
    """(sch, tbl, col, seen, was, now) of a stream of observations against desired columns (sch, tbl, col, data_type, nullable)."""
    want = desired.select(*[F.col(k).alias(f"want_{k}") for k in KEY], F.col("data_type").alias("want_type"), F.col("nullable").alias("want_nullable"), F.lit(True).alias("wanted"))
    met = observed.where("seen IS NOT NULL").join(want, [F.col(k) == F.col(f"want_{k}") for k in KEY], "left").select(F.pmod(F.xxhash64(*KEY), F.lit(PACKS)).alias("pack"), *KEY, "seen", status().alias("now"))
    return met.groupBy("pack").applyInPandasWithState(follow, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def watch(observed: DataFrame, desired: DataFrame, out: str, state: str) -> StreamingQuery:
    """Append the changes of every batch to the folder out; state is the folder of the stream's checkpoint."""
    return transitions(observed, desired).writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out)


TYPE_OF = generated.choose("k", ("int4", "bigint", "text", "varchar(20)"))
OBSERVATIONS = f"""SELECT 's' || {generated.text('u % 7')} AS sch, 't' || {generated.text('u')} AS tbl, 'c' || {generated.text('k % 2')} AS col, k AS seen, e = 'error' AS gone,
    CASE WHEN e = 'view' THEN 'integer' WHEN e = 'click' THEN 'character varying(20)' ELSE {TYPE_OF} END AS data_type, e <> 'purchase' AS nullable FROM (SELECT event_id AS k, user_id AS u, event_type AS e FROM {{events}}) AS x"""
DESIRED = f"""SELECT 's' || {generated.text('u % 7')} AS sch, 't' || {generated.text('u')} AS tbl, 'c' || {generated.text('z')} AS col, {TYPE_OF} AS data_type, k % 3 > 0 AS nullable
    FROM (SELECT c_custkey AS u, c_nationkey AS k, c_nationkey % 2 AS z FROM {{customer}}) AS x"""


def drift_transitions(spark, sf_dir: str) -> DataFrame:
    """Every change of a column's status: three files of observations in turn, the second sent again, the last ones by a restarted stream."""
    folder = new_folder(spark, "drift")
    every = spark.sql(OBSERVATIONS, events=table(spark, sf_dir, "events"))
    desired = spark.sql(DESIRED, customer=table(spark, sf_dir, "customer"))
    third = every.agg(F.ceil((F.max("seen") + 1) / 3).alias("third")).first()["third"] or 1
    for run in ((0, 1), (1, 2)):
        for part in run:
            every.where(F.floor(F.col("seen") / third) == part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/in")
        watch(stream, desired, f"{folder}/out", f"{folder}/state").awaitTermination()
    told = checkpoint(spark.read.schema(CHANGES).parquet(f"{folder}/out"))
    remove(spark, folder)
    return told


QUERIES = {"drift_transitions": drift_transitions}

ORACLES = {
    "drift_transitions": f"""
        WITH o AS ({OBSERVATIONS.replace("{events}", "events")}), d AS ({DESIRED.replace("{customer}", "customer")}),
        n AS (SELECT o.sch, o.tbl, o.col, seen, CASE WHEN gone THEN CASE WHEN d.sch IS NOT NULL THEN 'missing' ELSE 'in sync' END WHEN d.sch IS NULL THEN 'surplus'
            WHEN replace(replace(o.data_type, 'character varying', 'varchar'), 'int4', 'integer') = replace(replace(d.data_type, 'character varying', 'varchar'), 'int4', 'integer') AND o.nullable = d.nullable THEN 'in sync' ELSE 'differs' END AS now
            FROM o LEFT JOIN d ON d.sch = o.sch AND d.tbl = o.tbl AND d.col = o.col)
        SELECT sch, tbl, col, seen, was, now FROM (SELECT *, coalesce(lag(now) OVER (PARTITION BY sch, tbl, col ORDER BY seen), 'unknown') AS was FROM n) WHERE was <> now""",
}
