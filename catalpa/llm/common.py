"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

#: Texts go to Python workers so many at a time.
TEXT_ROWS = 1000
#: What is broadcast is not larger.
BROADCAST_BYTES = 64 * 2**20
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def remainder(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo mod; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod


def hashed(*columns: str | Column) -> Column:
    """A hash of the columns, 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """A name for each wanted one that no column has, in any case of its letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its plain name, whatever signs the name holds."""
    return F.col(quoted(name))


def chosen(hashes: DataFrame, rows: int) -> DataFrame:
    """At most rows different values of the one column of hashes, the least ones, the same on each run.

    A cut by value comes before the order, so little more than rows values leave the tasks, however many there are and
    however often one of them repeats.
    """
    (h,) = hashes.columns
    n = hashes.agg(F.approx_count_distinct(h)).first()[0]
    if n > 3 * rows:
        hashes = hashes.where(F.col(h) < int(2.0 * rows / n * 2**63))
    return hashes.distinct().orderBy(h).limit(rows)


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """At most rows different rows of df, chosen by a hash of the whole row, the same on each run; equal rows count once."""
    (h,) = fresh(df.columns, "h")
    marked = df.withColumn(h, hashed(*[col(c) for c in df.columns]))
    few = chosen(marked.select(h), rows)
    return marked.join(F.broadcast(few), h, "left_semi").dropDuplicates([h]).drop(h)  # few: at most rows longs


def small(df: DataFrame, size: Column) -> DataFrame:
    """df, to be broadcast if its rows, of so many bytes each, are few and short; df should come from a checkpoint."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_batches(docs: DataFrame) -> DataFrame:
    """docs, after the session's Arrow batches were limited to TEXT_ROWS rows, so that a batch of long texts fits a worker."""
    spark = docs.sparkSession
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= TEXT_ROWS:
        spark.conf.set(ARROW_ROWS, str(TEXT_ROWS))
    return docs


def with_made(docs: DataFrame, keep: list[str], read: list[str], make: Callable[..., dict[str, list]], made: dict[str, DataType], rows: int = TEXT_ROWS) -> DataFrame:
    """The columns keep of docs, untouched, beside columns that make(lists of the columns read) gives for so many rows at a time.

    Columns pass a worker as Arrow arrays: longs beside nulls, decimals, nested values and the like stay what they are.
    """
    fields = [StructField(name, kind) for name, kind in made.items()]
    arrow = to_arrow_schema(StructType(fields))
    out = StructType([docs.schema[c] for c in keep] + fields)
    n = len(keep)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                own = make(*[batch.column(n + i).to_pylist() for i in range(len(read))])
                columns = [batch.column(i) for i in range(n)] + [pa.array(own[f.name], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *arrow.names])

    given = docs.select(*[col(c) for c in keep], *[col(c).alias(name) for c, name in zip(read, fresh(keep, *read))])
    return text_batches(given).mapInArrow(each, out)


def arrow_rows(columns: dict[str, list], kinds: pa.Schema) -> pa.RecordBatch:
    """A batch of the columns, with the kinds' types and order."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in kinds], schema=kinds)


def gathered(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches put together until they have so many rows, for light rows that are better handled many at once."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += len(batch)
        if total >= rows:
            yield together(held)
            held, total = [], 0
    if held:
        yield together(held)


def together(batches: list[pd.DataFrame]) -> pd.DataFrame:
    """One frame; text columns hold plain strings, as columns of several chunks can't go back to Arrow as one array."""
    whole = pd.concat(batches, ignore_index=True)
    return whole.astype({c: object for c, kind in whole.dtypes.items() if pd.api.types.is_string_dtype(kind)})
