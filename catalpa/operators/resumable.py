"""Backfill that can be broken off and taken up again, chunk by chunk along a key.

A job lives in one folder of the shared file system:

    plan/     the chunks: (chunk, low, high, rows), half-open key ranges without gaps, written once before any work
    data/     the filled rows, by attempt and chunk
    commits/  one row for each chunk that an attempt finished: (chunk, attempt, at, rows, digest)

A run takes open chunks (those without a commit), writes their rows to a folder of its own attempt, counts what it wrote, and only then commits
with one appended file. What a broken run wrote is never read. Of two runs that finish the same chunk the first commit counts, so no chunk is lost or stands twice.
The first chunk is open below and the last above, so rows that come after planning belong to a chunk as well.

Defined cases: rows whose key holds a null come before all others. Rows of one key share a chunk. A null that has nothing to be filled from stays null.
A chunk whose rows are gone is committed with none. An empty table has one chunk, open on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalpa.operators.batches import backfill, chunk_bounds
from catalpa.operators.intervals import literal, route
from catalpa.session import checkpoint, exists, new_folder, remove, small, table


def key_of(key: list[str]) -> Column:
    return F.struct(*key)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The planned chunks."""
    return spark.read.parquet(f"{folder}/plan").dropDuplicates(["chunk"])


def plan(df: DataFrame, key: list[str], size: int, folder: str) -> DataFrame:
    """Write the chunks of about `size` rows, or read them where they have been planned before."""
    spark = df.sparkSession
    if not exists(spark, f"{folder}/plan/_SUCCESS"):
        kind = df.select(key_of(key).alias("key")).schema["key"].dataType
        firsts = chunk_bounds(df, key if len(key) > 1 else key[0], size).select(F.col("first_key").alias("first") if len(key) > 1 else F.struct(F.col("first_key").alias(key[0])).alias("first"), "chunk", "rows")
        # Several chunks may start at one key; the last of them has its rows, so each starts a range of its own, if an empty one.
        by = Window.orderBy("chunk")  # a row for each chunk
        ranges = firsts.select("chunk", F.when(F.col("chunk") > 1, F.col("first")).alias("low"), F.lead("first").over(by).alias("high"))
        if ranges.isEmpty():
            ranges = spark.range(1, 2).select(F.col("id").alias("chunk"), F.lit(None).cast(kind).alias("low"), F.lit(None).cast(kind).alias("high"))
        ranges.coalesce(1).write.mode("ignore").parquet(f"{folder}/plan")
    return read(spark, folder)


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """All commits, also those of doubled runs."""
    schema = "chunk long, attempt string, at timestamp, rows long, digest long"
    return spark.read.schema(schema).parquet(f"{folder}/commits") if exists(spark, f"{folder}/commits") else spark.createDataFrame([], schema)


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """The commit of each chunk that counts: its first one."""
    first = commits(spark, folder).groupBy("chunk").agg(F.min(F.struct("at", "attempt", "rows", "digest")).alias("c"))
    return first.select("chunk", "c.*")


def still_open(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """Chunks without a commit, at most so many, by key."""
    waiting = read(spark, folder).join(finished(spark, folder).select("chunk"), "chunk", "left_anti")
    return waiting if most is None else waiting.orderBy("chunk").limit(most)


def digest(columns: list[str]) -> Column:
    """Order-free: the xor of the rows' hashes, nulls told from values."""
    return F.bit_xor(F.xxhash64(*columns, *[F.col(c).isNull() for c in columns]))


def write(df: DataFrame, key: list[str], new: str, old: str, folder: str, most: int | None = None) -> str | None:
    """Fill the rows of open chunks and write them as a new attempt, uncommitted; its name, or None where nothing is open."""
    spark = df.sparkSession
    chosen = checkpoint(still_open(spark, folder, most))
    ends = chosen.agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.count_if(F.col("low").isNull()).alias("from_start"), F.count_if(F.col("high").isNull()).alias("to_end")).first()
    if not ends["n"]:
        return None
    rows = df
    if not ends["from_start"]:  # both bounds reach the scan
        rows = rows.where(F.col(key[0]) >= literal(ends["low"][0]))
    if not ends["to_end"]:
        rows = rows.where((F.col(key[0]) <= literal(ends["high"][0])) | F.col(key[0]).isNull())
    attempt = uuid.uuid4().hex
    dealt = route(backfill(rows, new, old), key_of(key), chosen.select(F.col("chunk").alias("part"), "low", "high"), "chunk", "inner")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // ends["n"])  # of a chunk, where there are fewer chunks than partitions
    dealt.repartition("chunk", F.pmod(F.xxhash64(*df.columns), F.lit(tasks))).write.partitionBy("chunk").parquet(f"{folder}/data/attempt={attempt}")
    chosen.select("chunk").coalesce(1).write.parquet(f"{folder}/taken/attempt={attempt}")
    return attempt


def commit(spark: SparkSession, folder: str, attempt: str, key: list[str], schema: StructType) -> int:
    """Count what an attempt wrote, chunk by chunk, and commit it with one file; the number of chunks."""
    taken = checkpoint(spark.read.parquet(f"{folder}/taken/attempt={attempt}"))
    written = written_rows(spark, folder, schema, attempt).groupBy(F.col("chunk").alias("c")).agg(F.count("*").alias("rows"), digest(schema.fieldNames()).alias("digest"))
    told = taken.join(written, F.expr("chunk = c"), "left").select("chunk", F.lit(attempt).alias("attempt"), F.current_timestamp().alias("at"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "digest")
    told.coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    return taken.count()


def written_rows(spark: SparkSession, folder: str, schema: StructType, attempt: str | None = None) -> DataFrame:
    """The rows in data/, with chunk and, where none is named, attempt."""
    path = f"{folder}/data" if attempt is None else f"{folder}/data/attempt={attempt}"
    own = StructType(list(schema.fields)).add("chunk", "long")
    return spark.read.schema(own if attempt else own.add("attempt", "string")).parquet(path)


def run(df: DataFrame, key: list[str], new: str, old: str, folder: str, most: int | None = None) -> int:
    """Take open chunks, at most so many, write and commit them; how many there were."""
    attempt = write(df, key, new, old, folder, most)
    return commit(df.sparkSession, folder, attempt, key, df.schema) if attempt else 0


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """(chunks, committed, rows, cursor): cursor is the end of the chunks that are committed without a gap, null before the first and after the last."""
    told = read(spark, folder).join(finished(spark, folder).select("chunk", F.lit(True).alias("done"), "rows"), "chunk", "left")
    least = told.where("done IS NULL").agg(F.min("chunk").alias("next"))
    marked = told.crossJoin(F.broadcast(least))  # one row
    return marked.agg(F.count("*").alias("chunks"), F.count("done").alias("committed"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.max(F.when(F.col("chunk") == F.col("next"), F.col("low"))).alias("cursor"))


def result(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows of all committed chunks, each chunk from the attempt whose commit counts."""
    if not exists(spark, f"{folder}/data"):
        return spark.createDataFrame([], schema)
    counted = checkpoint(finished(spark, folder).select(F.col("chunk").alias("__c"), F.col("attempt").alias("__a")))
    rows = written_rows(spark, folder, schema)
    return rows.join(small(counted, F.lit(64)), F.expr("chunk = __c AND attempt = __a"), "left_semi").select(*schema.fieldNames())


LINE_KEY = ["l_orderkey", "l_linenumber"]


def nullable_items(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_returnflag", F.expr("CASE WHEN l_partkey % 3 = 0 THEN l_suppkey END").alias("part"), F.expr("CASE WHEN l_partkey % 7 <> 0 THEN l_partkey END").alias("old_part"))


def broken_and_resumed(spark, sf_dir: str) -> tuple[str, StructType]:
    """A job over line items in eight chunks: a run over two, one that breaks before its commit, two at once over the same three, and one that finishes."""
    folder, items = new_folder(spark, "backfill"), nullable_items(spark, sf_dir)
    plan(items, LINE_KEY, max(1, -(-items.count() // 8)), folder)
    work = (items, LINE_KEY, "part", "old_part", folder)
    run(*work, most=2)
    write(*work, most=4)  # breaks: nothing it wrote may count
    doubled = [write(*work, most=3), write(*work, most=3)]
    for attempt in doubled:
        commit(spark, folder, attempt, LINE_KEY, items.schema)
    while run(*work):
        pass
    return folder, items.schema


def backfill_resumed(spark, sf_dir: str) -> DataFrame:
    """All line items after a broken, a doubled and a finishing run: as one pass would leave them."""
    folder, schema = broken_and_resumed(spark, sf_dir)
    whole = checkpoint(result(spark, folder, schema).groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("rows"), F.count("part").alias("filled"), F.coalesce(F.sum("part"), F.lit(0).cast("long")).alias("parts"), F.sum("l_linenumber").alias("lines")))
    remove(spark, folder)
    return whole


def backfill_manifest(spark, sf_dir: str) -> DataFrame:
    """The chunks with the key they start at (-1: open), their rows, and how often each was committed."""
    folder, _ = broken_and_resumed(spark, sf_dir)
    often = commits(spark, folder).groupBy("chunk").agg(F.countDistinct("attempt").alias("commits"))
    told = read(spark, folder).join(finished(spark, folder).select("chunk", "rows"), "chunk").join(often, "chunk")
    whole = checkpoint(told.select("chunk", F.coalesce("low.l_orderkey", F.lit(-1).cast("long")).alias("l_orderkey"), F.coalesce("low.l_linenumber", F.lit(-1)).alias("l_linenumber"), "rows", "commits"))
    remove(spark, folder)
    return whole


QUERIES = {f.__name__: f for f in (backfill_resumed, backfill_manifest)}

ORACLES = {
    "backfill_resumed": """
        WITH i AS (SELECT l_orderkey, l_returnflag, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey WHEN l_partkey % 7 <> 0 THEN l_partkey END AS part FROM lineitem)
        SELECT l_orderkey, l_returnflag, count(*) AS rows, count(part) AS filled, CAST(coalesce(sum(part), 0) AS BIGINT) AS parts, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM i GROUP BY ALL""",
    "backfill_manifest": """
        WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS n, (count(*) OVER () + 7) // 8 AS size FROM lineitem),
        c AS (SELECT CAST((n - 1) // size + 1 AS BIGINT) AS chunk, l_orderkey, l_linenumber FROM n WHERE (n - 1) % size = 0),
        r AS (SELECT greatest(1, (SELECT max(chunk) FROM c WHERE (c.l_orderkey, c.l_linenumber) <= (n.l_orderkey, n.l_linenumber))) AS chunk, count(*) AS rows FROM n GROUP BY ALL)
        SELECT chunk, CASE WHEN chunk > 1 THEN l_orderkey ELSE -1 END AS l_orderkey, CASE WHEN chunk > 1 THEN l_linenumber ELSE -1 END AS l_linenumber, coalesce(rows, 0) AS rows, CAST(CASE WHEN chunk BETWEEN 3 AND 5 THEN 2 ELSE 1 END AS BIGINT) AS commits
        FROM c LEFT JOIN r USING (chunk)""",
}
