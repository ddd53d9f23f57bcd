"""Drift as a stream: snapshots arrive as appended rows; after each batch all that has arrived is compared with the desired state.

An extension of the batch operators: the same difference runs inside foreachBatch. The latest row of each column is the state; it and the
changes are written by batch number, so a batch that is run again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalpa.functions import sqltypes
from catalpa.plans.changes import column_changes, scoped


def watch_columns(live: DataFrame, desired: DataFrame, renames: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the column changes that are left after every batch of live snapshot rows to out, a folder for each batch.

    Rows of one column in one batch should be equal; of several batches the latest counts.
    """
    states = checkpoint.rstrip("/") + "_snapshots"

    def compare(batch: DataFrame, number: int) -> None:
        key = scoped(batch, "tbl", "col")
        now = batch.dropDuplicates(key)
        if number:
            before = batch.sparkSession.read.parquet(f"{states}/{number - 1}")
            now = before.join(now.select(*key), key, "left_anti").unionByName(now)
        now.write.mode("overwrite").parquet(f"{states}/{number}")
        now = batch.sparkSession.read.parquet(f"{states}/{number}")
        column_changes(now, desired, renames, sqltypes.is_managed(F.col("tbl"))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return live.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_windows(ledger: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Records of a ledger stream by status and window of applied_at; records later than the watermark are left out."""
    return ledger.withWatermark("applied_at", late).groupBy(F.window("applied_at", width).alias("w"), "status").agg(F.count("*").alias("records")).select(F.col("w.start").alias("from"), "status", "records")
