"""Centroid clustering in whole numbers, screened by block norms.

Each vector's components become floor(scale * x). Centroids start as given rows of the table, by a hash of their ids. In a round every
vector goes to its nearest centroid, then centroids move to their vectors' exact mean, rounded down by component.

A vector is compressed once to the lengths of its SEGMENT-wide parts, and so is each centroid in each round. By Cauchy-Schwarz a part's inner
product is at most the product of its lengths, so the squared distance is at least the sum of squared differences of lengths.
A vector meets the centroid with the least such bound first; of the others, only those whose bound doesn't exceed the best distance so far get
an exact distance, in whole numbers.

Sums are taken inside tasks, then by Spark over a row for each task, centroid and component; the driver holds k * width numbers, however
many vectors there are.

Defined cases: vectors that are null, of another width, or hold null, NaN or infinite components take no part. Ties go to the smaller number.
Vectors without an id are clustered but start no centroid; rows that share an id are told apart by their components, equal rows are equal starts.
Fewer vectors than centroids give fewer centroids; no vectors give no rows. Components are cut to the range of a long, sums of distances to that of decimal(38, 0), then of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalpa.llm.common import arrow_rows, col
from catalpa.session import checkpoint

SEGMENT = 8
#: Squared distances of components below this stay inside a long.
SAFE = 2**26
LONG = 2**63 - 1


def whole(vectors: DataFrame, width: int, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    x = col(vec_col)
    sound = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & (F.size(x) == width) & sound).select(col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def largest(v: np.ndarray) -> int:
    return max(int(v.max(initial=0)), -int(v.min(initial=0)))


def lengths(v: np.ndarray) -> np.ndarray:
    """The lengths of a row's segments."""
    squares = v.astype(float) ** 2
    return np.sqrt(np.add.reduceat(squares, range(0, v.shape[1], SEGMENT), axis=1)) if len(v) else np.empty((0, -(-v.shape[1] // SEGMENT)))


def distances(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances; beyond the safe range by Python's integers, cut to a long."""
    if max(largest(v), largest(centroid)) <= SAFE and v.shape[1] <= 256:
        gap = v - centroid
        return np.einsum("ij,ij->i", gap, gap)
    own = [int(c) for c in centroid]
    return np.array([min(LONG, sum((int(a) - b) ** 2 for a, b in zip(row, own))) for row in v], dtype=np.int64)


def nearest(v: np.ndarray, short: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid, its exact squared distance, and how many exact distances were taken."""
    heads = lengths(centroids)
    bound = (short**2).sum(1)[:, None] + (heads**2).sum(1)[None, :] - 2 * short @ heads.T
    bound -= 1e-9 * (1 + (short**2).sum(1)[:, None] + (heads**2).sum(1)[None, :])  # the bound's own rounding
    first = bound.argmin(1)
    best, cluster, taken = np.full(len(v), LONG), first.astype(np.int64), len(v)
    for c in np.unique(first):
        rows = np.flatnonzero(first == c)
        best[rows] = distances(v[rows], centroids[c])
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        if not len(rows):
            continue
        taken += len(rows)
        own = distances(v[rows], centroids[c])
        closer = (own < best[rows]) | ((own == best[rows]) & (c < cluster[rows]))
        best[rows[closer]], cluster[rows[closer]] = own[closer], c
    return cluster, best, taken


def rows_of(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """An Arrow list column, all lists of one width, as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(-1, width)


def compressed(found: DataFrame, width: int) -> DataFrame:
    """found with the segments' lengths beside each vector."""
    parts = [F.sqrt(F.aggregate(F.slice("v", at + 1, SEGMENT), F.lit(0.0), lambda n, c: n + c.cast("double") * c.cast("double"))) for at in range(0, width, SEGMENT)]
    return found.withColumn("short", F.array(*parts))


def starts(found: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the least SHA-256 of salt and id, in their order; equal hashes by components."""
    hashes = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = found.where("vec_id IS NOT NULL").select(hashes.alias("hash"), "v").orderBy("hash", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], dtype=np.int64)


def moved(found: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, width = centroids.shape
    shared = found.sparkSession.sparkContext.broadcast(centroids)
    kind = "cluster int, rows long, sums array<decimal(38,0)>"
    arrow = pa.schema([("cluster", pa.int32()), ("rows", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=object)
        for batch in batches:
            v = rows_of(batch.column("v"), width, np.int64)
            cluster, _, _ = nearest(v, rows_of(batch.column("short"), -(-width // SEGMENT), float), shared.value)
            small = largest(v) <= 2**40  # sums of a batch fit a long
            for c in np.unique(cluster):
                own = v[cluster == c]
                counts[c] += len(own)
                sums[c] += own.sum(0).astype(object) if small else own.astype(object).sum(0)
        held = np.flatnonzero(counts)
        yield arrow_rows({"cluster": held.tolist(), "rows": counts[held].tolist(), "sums": [[int(x) for x in sums[c]] for c in held]}, arrow)

    parts = found.select("v", "short").mapInArrow(add, kind).select("cluster", "rows", F.posexplode("sums").alias("place", "part"))
    total = parts.groupBy("cluster", "place").agg(F.sum("rows").alias("rows"), F.sum("part").alias("total")).collect()  # k * width rows
    out = centroids.copy()
    for r in total:
        out[r["cluster"], r["place"]] = int(r["total"]) // r["rows"]
    shared.unpersist()
    return out


def cluster(vectors: DataFrame, k: int, rounds: int, scale: float, width: int, salt: str, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, after so many rounds, and the centroids."""
    found = checkpoint(compressed(whole(vectors, width, scale, id_col, vec_col), width))
    centroids = starts(found, k, salt).reshape(-1, width)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(found, centroids)
    return assigned(found, centroids), centroids


def assigned(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of the vectors; none where there are no centroids."""
    width = centroids.shape[1]
    shared = found.sparkSession.sparkContext.broadcast(centroids)
    arrow = pa.schema([("cluster", pa.int32()), ("distance", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, best, _ = nearest(rows_of(batch.column("v"), width, np.int64), rows_of(batch.column("short"), -(-width // SEGMENT), float), shared.value)
            made = arrow_rows({"cluster": own.tolist(), "distance": best.tolist()}, arrow)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *made.columns], names=["vec_id", "cluster", "distance"])

    return found.where(F.lit(len(centroids) > 0)).select("vec_id", "v", "short").mapInArrow(each, "vec_id long, cluster int, distance long")


def report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found, with each cluster's and the whole inertia and the digest of its centroid's components."""
    spark = found.sparkSession
    kept = checkpoint(found)
    texts = [(c, ",".join(map(str, row.tolist()))) for c, row in enumerate(centroids)]
    digests = spark.createDataFrame(texts, "c int, components string").select("c", F.sha2(F.col("components").cast("binary"), 256).alias("centroid_sha256"))
    inertia = kept.groupBy(F.col("cluster").alias("c")).agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    total = inertia.agg(F.sum("own").alias("whole"))
    cut = lambda c: F.least(F.col(c), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    told = inertia.join(F.broadcast(digests), "c").crossJoin(F.broadcast(total))  # k rows and one
    told = told.select("c", cut("own").alias("cluster_inertia"), cut("whole").alias("inertia"), "centroid_sha256")
    return kept.join(F.broadcast(told), F.col("cluster") == F.col("c")).drop("c")
