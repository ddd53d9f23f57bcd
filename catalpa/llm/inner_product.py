"""Exact top-k by inner product: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

Vectors are dealt into bands by descending length, bands into blocks. A query gets a first threshold from the longest vectors.
Bands are met in waves, each about GROWTH times as large as all before it together; after each wave a query's threshold rises to the
k-th best score found so far. A block is not sent to queries where the product of lengths can't reach the
threshold, and inside a block vectors are dropped as soon as the partial sum over
the leading rotated dimensions plus the product of the remaining lengths can't. What is left is scored in whole numbers.

Defined cases: vectors that are null or hold null, NaN or infinite components, and rows without an id, take no part. Shorter vectors count as filled
up with zeros, so an empty vector scores 0. Ties go to the smaller id. A query id that repeats is answered once, by its
least vector. Rows sharing the query's id are never its candidates. Scores beyond the range of a long are cut to that range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalpa.llm.common import bounded_sample, col
from catalpa.session import checkpoint

BLOCK = 1024
QUERY_BLOCK = 4096
ROWS = 1024
GROUPS = 32
GROWTH = 4
BANDS = 256
HEAD = 1024
SVD_SAMPLE = 4096
LEADING = (8, 24)
LONG = 2**63 - 1


def quantised(vectors: DataFrame, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<long>, norm) of the vectors that take part."""
    x = col(vec_col)
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    sound = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    found = vectors.where(x.isNotNull() & sound & col(id_col).isNotNull()).select(col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    return found.select("vec_id", "v", length.alias("norm"))


def matrix(rows, width: int) -> np.ndarray:
    """float64 rows filled up with zeros."""
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def whole_numbers(rows, width: int) -> np.ndarray:
    """int64 rows filled up with zeros."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as int64; float64 sums are exact below 2**52, beyond that Python integers are used."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < 2.0**52:
        return (q @ c.T).astype(np.int64)
    wide = np.vectorize(int, otypes=[object])
    product = wide(q) @ wide(c).T
    return np.vectorize(lambda s: max(-LONG, min(LONG, int(s))), otypes=[np.int64])(product)


def best(scores: np.ndarray, ids: np.ndarray, own: int, least: float, k: int) -> list[tuple[int, int]]:
    """At most k (score, id) of one query, from the highest; none below least."""
    keep = np.flatnonzero((scores >= least) & (ids != own))
    if len(keep) > k:
        cut = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
        keep = keep[scores[keep] >= cut]
    order = np.lexsort((ids[keep], -scores[keep]))[:k]
    return [(int(scores[keep[i]]), int(ids[keep[i]])) for i in order]


def scan_block(queries: np.ndarray, own: np.ndarray, least: np.ndarray, ids: np.ndarray, cands: np.ndarray, rotation: np.ndarray, k: int):
    """(query row, score, id) of each query's k best in a block, at or above its threshold; ROWS queries at a time."""
    for at in range(0, len(queries), ROWS):
        part = slice(at, at + ROWS)
        yield from ((at + row, score, vec) for row, score, vec in scan_part(queries[part], own[part], least[part], ids, cands, rotation, k))


def scan_part(queries: np.ndarray, own: np.ndarray, least: np.ndarray, ids: np.ndarray, cands: np.ndarray, rotation: np.ndarray, k: int):
    order = np.argsort(-(cands**2).sum(1), kind="stable")
    ids, cands = ids[order], cands[order]
    rq, rc = queries @ rotation, cands @ rotation
    slack = 1e-9 * (1 + np.sqrt((queries**2).sum(1)))[:, None] * (1 + np.sqrt((cands**2).sum(1)))[None, :] + 1e-6
    alive = np.sqrt((queries**2).sum(1))[:, None] * np.sqrt((cands**2).sum(1))[None, :] + slack >= least[:, None]
    for lead in LEADING:
        if lead >= rotation.shape[1] or not alive.any():
            break
        q_rest, c_rest = (np.sqrt((m[:, lead:] ** 2).sum(1)) for m in (rq, rc))
        alive &= rq[:, :lead] @ rc[:, :lead].T + q_rest[:, None] * c_rest[None, :] + slack >= least[:, None]
    rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
    if not len(rows):
        return
    scores = exact(queries[rows], cands[cols])
    for at, row in enumerate(rows):
        for score, vec in best(scores[at], ids[cols], own[row], least[row], k):
            yield row, score, vec


def bands_of(found: DataFrame, n: int) -> tuple[Column, list]:
    """The band (0: the longest) of a row, and the bands' (band, rows, longest), from quantiles of the lengths."""
    edges = sorted(set(found.approxQuantile("norm", [i / BANDS for i in range(1, BANDS)], 0.001))) if n > BLOCK else []
    band = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e > F.col("norm"))) if edges else F.lit(0)
    rows = found.groupBy(band.alias("band")).agg(F.count("*").alias("rows"), F.max("norm").alias("longest")).orderBy("band").collect()  # BANDS rows at most
    return band, [(r["band"], r["rows"], r["longest"]) for r in rows]


def waves_of(bands: list) -> list[list[tuple[int, int, float]]]:
    """The bands' (band, blocks, longest) in waves by descending length, each of about GROWTH times the rows of all before it."""
    waves, done, size = [], 0, 0
    for band, rows, longest in bands:
        if not waves or size >= max(GROWTH * BLOCK, (GROWTH - 1) * done):
            waves.append([])
            done, size = done + size, 0
        waves[-1].append((band, math.ceil(rows / BLOCK), longest))
        size += rows
    return waves


def best_rows(met: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) of each query; rows beyond go before the shuffle."""
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k best candidates of each query (ids divisible by `every`): query_id, rank, vec_id, score."""
    found = checkpoint(quantised(vectors, scale, id_col, vec_col))
    is_query = F.col("vec_id") % every == 0
    size = found.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.approx_count_distinct(F.when(is_query, F.col("vec_id"))).alias("q")).first()
    width, n_query_blocks = max(1, size["d"] or 0), max(1, math.ceil(size["q"] / QUERY_BLOCK))
    sample = bounded_sample(found.select("vec_id", "v"), min(SVD_SAMPLE, max(64, 2**24 // width))).collect()
    rotation = np.linalg.svd(matrix([r["v"] for r in sample], width), full_matrices=True)[2].T if sample else np.eye(width)
    band, bands = bands_of(found, size["n"])
    top, upto = 0, 0
    while top < len(bands) and upto < HEAD:
        upto, top = upto + bands[top][1], top + 1
    head_rows = bounded_sample(found.where(band < top).select("vec_id", "v"), min(HEAD, max(64, 2**22 // width))).dropDuplicates(["vec_id"]).collect()  # of the longest vectors
    shared = vectors.sparkSession.sparkContext.broadcast((rotation, matrix([r["v"] for r in head_rows], width), np.array([r["vec_id"] for r in head_rows], dtype=np.int64)))

    def seed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, head, head_ids = shared.value
        for part in batches:
            scores = exact(matrix(part["v"].tolist(), width), head)
            first = [best(s, head_ids, own, -np.inf, k) for s, own in zip(scores, part["vec_id"])]
            yield part.assign(least=[np.nextafter(float(f[-1][0]), -np.inf) if len(f) == k else -np.inf for f in first])

    once = found.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("one")).select("vec_id", "one.v", "one.norm")
    asked = checkpoint(once.mapInPandas(seed, "vec_id long, v array<bigint>, norm double, least double"))
    # Queries whose thresholds ask for like lengths share a block, so that a block of queries passes over the same candidates.
    reach = F.col("least") / F.greatest(F.col("norm"), F.lit(1e-9))
    groups = min(GROUPS, n_query_blocks)
    likes = sorted(set(asked.withColumn("reach", reach).where("reach > double('-inf')").approxQuantile("reach", [i / groups for i in range(1, groups)], 0.01))) if groups > 1 else []
    alike = F.size(F.filter(F.array(*[F.lit(e) for e in likes]), lambda e: e > reach)) if likes else F.lit(0)
    parts = math.ceil(n_query_blocks / (len(likes) + 1))
    asked = checkpoint(asked.withColumn("q_block", (alike * parts + F.pmod(F.xxhash64("vec_id"), F.lit(parts))).cast("long")))
    dealt = found.select("vec_id", "v", band.alias("band"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        """A block of queries as one row; open is the least length of a candidate that could still serve one of them."""
        norm, least = rows["norm"].to_numpy(float), rows["least"].to_numpy(float)
        needs = np.where(norm > 0, (least - 1e-3) / np.maximum(norm * 1.000001, 1e-300), np.where(least <= 1e-3, -np.inf, np.inf))
        v = whole_numbers(rows["v"].tolist(), width)
        return pd.DataFrame({"q_block": rows["q_block"].iloc[:1].to_numpy(), "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "queries": [v.tobytes()], "least": [least.tobytes()], "open": [needs.min()]})

    def meet(blocks: pd.DataFrame, own_block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(blocks) and len(own_block):
            ids, queries, least = (np.frombuffer(blocks[c].iloc[0], dtype=kind) for c, kind in (("ids", np.int64), ("queries", np.int64), ("least", np.float64)))
            found_rows = scan_block(queries.reshape(-1, width).astype(float), ids, least, own_block["vec_id"].to_numpy(np.int64), matrix(own_block["v"].tolist(), width), shared.value[0], k)
            out = [(ids[row], vec, score) for row, score, vec in found_rows]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    result, block = None, ["q_block", "band", "place"]
    for wave in waves_of(bands):
        if result is not None:  # what is found so far raises the thresholds
            full = result.groupBy("query_id").agg(F.min("score").cast("double").alias("low"), F.count("*").alias("have")).where(F.col("have") == k)
            low = F.col("low") - F.abs("low") * 1e-15
            asked = checkpoint(asked.join(full, F.col("vec_id") == F.col("query_id"), "left").withColumn("least", F.greatest("least", F.coalesce(low, "least"))).drop("query_id", "low", "have"))
        packs = checkpoint(asked.groupBy("q_block").applyInPandas(pack, "q_block long, ids binary, queries binary, least binary, open double"))
        open_bands = F.filter(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(blocks).alias("blocks"), F.lit(float(longest)).alias("longest")) for b, blocks, longest in wave]), lambda b: b["longest"] >= F.col("open"))
        asks = packs.select("q_block", "ids", "queries", "least", F.explode(open_bands).alias("b")).select("q_block", "ids", "queries", "least", "b.band", F.explode(F.sequence(F.lit(0), F.col("b.blocks") - 1)).alias("place"))
        pairs = asks.select(F.col("q_block").alias("q"), F.col("band").alias("b"), F.col("place").alias("p"))
        cands = dealt.where(F.col("band").between(wave[0][0], wave[-1][0])).withColumn("place", F.pmod(F.xxhash64("vec_id", "v"), nth_of(wave)).cast("int"))
        cands = cands.join(pairs, F.expr("band = b AND place = p")).select("vec_id", "v", F.col("q").alias("q_block"), "band", "place")  # only blocks of queries that a block of candidates can still serve get it
        met = asks.groupBy(*block).cogroup(cands.groupBy(*block)).applyInPandas(meet, "query_id long, vec_id long, score long")
        result = checkpoint(best_rows(met if result is None else met.unionByName(result.drop("rank")), k))
    return result if result is not None else best_rows(found.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")).where("false"), k)


def nth_of(wave: list[tuple[int, int, float]]) -> Column:
    """The number of blocks of a row's band."""
    return F.get(F.array(*[F.lit(blocks) for _, blocks, _ in wave]), F.col("band") - wave[0][0])
