"""What came before a row, along ranges, so that no task holds all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalpa.session import checkpoint


def last_before(df: DataFrame, by: list[str], order: str, value: Column, name: str, slices: int | None = None) -> DataFrame:
    """df with the last value that isn't null of the rows before, of the same key (nulls equal each other), by `order`, which must be unique in a key.

    Rows are cut by ranges of (by, order); a piece looks into itself, and what earlier pieces of its key end with is carried over, a row for each piece and key.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(df.withColumn("__v", value).repartitionByRange(slices, *by, order).withColumn("__s", F.spark_partition_id()))
    ends = placed.groupBy(*[F.col(b).alias(f"__{b}") for b in by], F.col("__s").alias("__t")).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(order))).alias("__end"))
    earlier = Window.partitionBy(*[f"__{b}" for b in by]).orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__c", F.last("__end", ignorenulls=True).over(earlier)).drop("__end")
    inside = Window.partitionBy("__s", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__s") == F.col("__t")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"__{b}"))
    found = placed.withColumn("__i", F.last("__v", ignorenulls=True).over(inside)).join(carried, same)
    return found.withColumn(name, F.coalesce("__i", "__c")).drop("__v", "__s", "__t", "__i", "__c", *[f"__{b}" for b in by])
