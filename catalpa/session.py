"""Session helpers shared by all Spark jobs of the package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is broadcast is not larger.
BROADCAST_BYTES = 64 * 2**20


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables beside each other in sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.

    Where neither the context nor the session names a folder, one is made here, but only for a session on one machine; a cluster's executors
    would each write to their own disks, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a folder of its own in the shared one; nothing is made yet."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def files_of(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark's own file access sees them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = files_of(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Take a folder away with all it holds."""
    files, place = files_of(spark, path)
    files.delete(place, True)


def small(df: DataFrame, size: Column) -> DataFrame:
    """df, to be broadcast if its rows, of so many bytes each, sum up to BROADCAST_BYTES at most; df should come from a checkpoint."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df
