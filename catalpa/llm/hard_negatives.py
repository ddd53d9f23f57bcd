"""Hard-negative mining over k-means inverted lists with stored radii.

Every row belongs to the list of its nearest centre; a list stores its radius, the furthest distance of a row from the centre. By Cauchy-Schwarz
a row's inner product with an anchor a is at most a.c + |a| radius and at least a.c - |a| radius. An anchor visits lists by
descending upper bound, skips lists whose bounds lie outside its window of scores, and stops when the upper bound falls strictly below its k-th
best score so far. Both searches run this way: an anchor's positives (rows of its label) over lists of its label alone, then, for the window
that each positive's score gives, the negatives (rows of other labels) over all lists.

On Spark, anchors of like lists form blocks of at most about PACK requests, and open lists are put together to chunks of about CHUNK rows. A chunk gets the pack of a
block once, so packs add little to what is shuffled; lists larger than a chunk are cut by a hash. First each request's FIRST best lists are visited for a threshold,
then every list that it leaves open to the request, the first ones among them: a list that one request of a block has visited is still new to the others.
Nothing is capped: a list is left out only where a bound proves it useless.

Centres are fitted on at most SAMPLE different rows; every row is indexed, and results are exact whatever the centres are.

Defined cases: rows without an id, and rows whose label or vector is null or whose vector holds null, NaN or infinite components, take no part. Labels are whole numbers.
Shorter vectors count as filled up with zeros. Ties go to the smaller id. An anchor id that repeats is answered once, by one of
its rows, the same on each run; rows that share the anchor's id are never its partners; other repeated ids count row by row. A negative positive score has no window.
An anchor without a positive, and a positive without a negative, give no rows. Scores beyond the range of a long are cut to that range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalpa.llm.common import bounded_sample, col, small
from catalpa.llm.inner_product import exact, matrix
from catalpa.session import checkpoint

SAMPLE = 4096
TURNS = 10
MOST_LISTS = 256
PACK = 2048
CHUNK = 8192
FIRST = 2
LONG = 2**63 - 1
BLOCK = ["grp", "region", "pack"]


def taking_part(vectors: DataFrame, scale: float, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v array<long>) of the rows that take part."""
    x = col(vec_col)
    sound = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept = vectors.where(x.isNotNull() & sound & col(id_col).isNotNull() & col(label_col).isNotNull())
    return kept.select(col(id_col).cast("long").alias("vec_id"), col(label_col).cast("long").alias("label"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def centres_of(rows: np.ndarray, k: int) -> np.ndarray:
    """At most k means of the rows by Lloyd's turns, from rows spread over the sample."""
    own = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)].copy()
    for _ in range(TURNS):
        near = ((own**2).sum(1)[None, :] - 2 * rows @ own.T).argmin(1)
        for c in np.unique(near):
            own[c] = rows[near == c].mean(0)
    return own


def regions_of(centres: np.ndarray, n: int) -> np.ndarray:
    """The region, 0 to n - 1, of each list: centres in order along their main direction, cut into equal runs."""
    main = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
    place = np.empty(len(centres), dtype=int)
    place[np.argsort(centres @ main, kind="stable")] = np.arange(len(centres))
    return place * min(n, len(centres)) // len(centres)


def dealt(df: DataFrame, keys: list[str], part: str, most: int, by: list[str]) -> DataFrame:
    """df with a part number: the rows of a key are dealt by a hash into parts of about `most` rows."""
    sizes = checkpoint(df.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("long").alias("parts")))
    named = sizes.select(*[F.col(k).alias(f"{k}_") for k in keys], "parts")
    same = " AND ".join(f"{k} = {k}_" for k in keys)
    return df.join(small(named, F.lit(32)), F.expr(same)).withColumn(part, F.pmod(F.xxhash64(*by), F.col("parts")).cast("int")).drop("parts", *[f"{k}_" for k in keys])


def indexed(found: DataFrame, every: int, pack: int) -> tuple[DataFrame, np.ndarray, np.dtype]:
    """(vec_id, label, v binary, list, far, region) of all rows, the lists' centres and the kind of numbers in v."""
    is_anchor = F.col("vec_id") % every == 0
    size = found.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.count_if(is_anchor).alias("anchors"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    width, most = max(1, size["d"] or 0), max(-(size["low"] or 0), size["high"] or 0)
    kind = np.dtype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8")
    sample = sorted(r["v"] for r in bounded_sample(found.select("v"), min(SAMPLE, max(64, 2**24 // width))).collect())
    lists = max(1, min(MOST_LISTS, math.isqrt(size["n"]) // 4))
    centres = centres_of(matrix(sample, width), lists) if sample else np.zeros((1, width))
    regions = regions_of(centres, math.ceil(size["anchors"] / pack) or 1)
    shared = found.sparkSession.sparkContext.broadcast((centres, regions))
    arrow = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.binary()), ("list", pa.int32()), ("far", pa.float64()), ("region", pa.int32())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, region = shared.value
        for batch in batches:
            v = np.zeros((batch.num_rows, width), dtype=np.int64)
            for i, row in enumerate(batch.column("v").to_pylist()):
                v[i, : len(row)] = row
            x = v.astype(float)
            near = ((own**2).sum(1)[None, :] - 2 * x @ own.T).argmin(1)
            far = np.sqrt(((x - own[near]) ** 2).sum(1))
            bodies = [row.tobytes() for row in v.astype(kind)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(bodies, pa.binary()), pa.array(near, pa.int32()), pa.array(far), pa.array(region[near], pa.int32())], schema=arrow)

    return checkpoint(found.mapInArrow(each, "vec_id long, label long, v binary, list int, far double, region int")), centres, kind


def best_rows(met: DataFrame, k: int) -> DataFrame:
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k)


class Search:
    """Exact k best rows for each request (grp, region, anchor, nth, label, v, lo, hi) among the rows of its grp."""

    def __init__(self, rows: DataFrame, grp: Column, centres: np.ndarray, kind: np.dtype, same: bool, k: int):
        self.centres, self.kind, self.same, self.k = centres, kind, same, k
        self.rows = checkpoint(dealt(rows.withColumn("grp", grp), ["grp", "list"], "part", CHUNK, ["vec_id", "v"]))
        self.lists = checkpoint(self.rows.groupBy("grp", "list", "part").agg(F.count("*").alias("n"), F.max("far").alias("radius")))  # a row for each part

    def best(self, requests: DataFrame) -> DataFrame:
        """(anchor, nth, rank, vec_id, score)."""
        asked = checkpoint(dealt(requests, ["grp", "region"], "pack", PACK, ["anchor"]).withColumn("least", F.lit(-LONG)))
        own = self.lists.withColumnRenamed("grp", "g")
        lists = checkpoint(asked.select(*BLOCK).distinct().join(own, F.expr("grp = g")).drop("g"))
        result = None
        for first in (FIRST, None):
            if result is not None:  # what is found so far raises the thresholds
                full = result.groupBy("anchor", "nth").agg(F.min("score").alias("low"), F.count("*").alias("have")).where(F.col("have") == self.k)
                low = full.select(F.col("anchor").alias("a"), F.col("nth").alias("t"), "low")
                asked = checkpoint(asked.join(low, F.expr("anchor = a AND nth = t"), "left").withColumn("least", F.coalesce("low", "least")).drop("a", "t", "low"))
            packs = checkpoint(asked.groupBy(*BLOCK).cogroup(lists.groupBy(*BLOCK)).applyInPandas(self.packed(first), "grp long, region int, pack int, chunk int, places array<struct<list:int,part:int,radius:double>>, requests binary, vectors binary"))
            places = packs.select(*[F.col(c).alias(f"{c}_") for c in (*BLOCK, "chunk")], F.explode("places").alias("p")).select("*", F.col("p.list").alias("l"), F.col("p.part").alias("q")).drop("p")
            cands = self.rows.drop("region").join(places, F.expr("grp = grp_ AND list = l AND part = q")).select(*[F.col(f"{c}_").alias(c) for c in (*BLOCK, "chunk")], "vec_id", "label", "v", "list")
            met = packs.groupBy(*BLOCK, "chunk").cogroup(cands.groupBy(*BLOCK, "chunk")).applyInPandas(self.met(), "anchor long, nth int, vec_id long, score long")
            result = checkpoint(best_rows(met, self.k))
        return result

    def packed(self, first: int | None):
        """Puts a block's requests beside the chunks of lists that are open to one of them, by descending upper bound; at most the first lists of each request."""
        centres, kind = self.centres, self.kind
        shared = self.rows.sparkSession.sparkContext.broadcast(centres)

        def pack(requests: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
            columns = [*BLOCK, "chunk", "places", "requests", "vectors"]
            if not len(requests) or not len(lists):
                return pd.DataFrame(columns=columns, dtype=object)
            lists = lists.sort_values(["list", "part"])
            each, index = np.unique(requests["anchor"].to_numpy(), return_index=True)
            row_of = np.searchsorted(each, requests["anchor"].to_numpy())
            v = np.frombuffer(b"".join(requests["v"].iloc[index]), dtype=kind).reshape(len(each), -1)
            high, low = bounds(v, shared.value[lists["list"].to_numpy()], lists["radius"].to_numpy(float))
            needs = np.maximum(requests["least"].to_numpy(np.int64), requests["lo"].to_numpy(np.int64)).astype(float)
            can = (high[row_of] >= needs[:, None]) & (low[row_of] <= requests["hi"].to_numpy(float)[:, None])
            if first is not None and can.shape[1] > first:
                told = np.where(can, high[row_of], -np.inf)
                can &= told >= np.partition(told, -first, axis=1)[:, -first][:, None]
            taken = np.flatnonzero(can.any(0))
            taken = taken[np.argsort(-np.where(can, high[row_of], -np.inf).max(0)[taken], kind="stable")]
            chunk = (np.cumsum(lists["n"].to_numpy()[taken]) - 1) // CHUNK
            table = np.column_stack([requests["anchor"], requests["nth"], requests["label"], requests["lo"], requests["hi"], requests["least"], row_of]).astype(np.int64)
            out = []
            for c in np.unique(chunk):
                part = lists.iloc[taken[chunk == c]]
                places = [{"list": int(p), "part": int(q), "radius": float(r)} for p, q, r in zip(part["list"], part["part"], part["radius"])]
                use = np.flatnonzero(can[:, taken[chunk == c]].any(1))
                out.append((*requests[BLOCK].iloc[0], int(c), places, table[use].tobytes(), v.tobytes()))
            return pd.DataFrame(out, columns=columns) if out else pd.DataFrame(columns=columns, dtype=object)

        return pack

    def met(self):
        """Visits a chunk's lists for a block of requests."""
        kind, same, k = self.kind, self.same, self.k
        shared = self.rows.sparkSession.sparkContext.broadcast(self.centres)

        def meet(packs: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(packs) and len(cands):
                pack = packs.iloc[0]
                table = np.frombuffer(pack["requests"], dtype=np.int64).reshape(-1, 7)
                width = shared.value.shape[1]
                v = np.frombuffer(pack["vectors"], dtype=kind).reshape(-1, width)
                order = list(dict.fromkeys(p["list"] for p in pack["places"]))
                radii = {p["list"]: max(q["radius"] for q in pack["places"] if q["list"] == p["list"]) for p in pack["places"]}
                body = np.frombuffer(b"".join(cands["v"]), dtype=kind).reshape(-1, width)
                whole = (table, v, order, radii, shared.value, cands["list"].to_numpy(), cands["vec_id"].to_numpy(np.int64), cands["label"].to_numpy(np.int64), body)
                out = [(int(table[r, 0]), int(table[r, 1]), vec, score) for r, found in enumerate(visited(*whole, same, k)) for score, vec in found]
            return pd.DataFrame(out, columns=["anchor", "nth", "vec_id", "score"])

        return meet


def bounds(v: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds on the inner products of each vector with the rows of each list, beyond their own rounding."""
    x = v.astype(float)
    norm, middle = np.sqrt((x**2).sum(1))[:, None], x @ centres.T
    reach = norm * (radii * (1 + 1e-9))[None, :] + 1e-9 * norm * (1 + np.sqrt((centres**2).sum(1)))[None, :] + 1e-6
    return middle + reach, middle - reach


def visited(table: np.ndarray, v: np.ndarray, order: list[int], radii: dict[int, float], centres: np.ndarray, lists: np.ndarray, ids: np.ndarray, labels: np.ndarray, body: np.ndarray, same: bool, k: int) -> list[list[tuple[int, int]]]:
    """The k best (score, id) of each request, lists visited in the order given; a list is skipped where its bound is below the k-th score."""
    found: list[list[tuple[int, int]]] = [[] for _ in table]
    _, _, label, lo, hi, least, row_of = table.T
    least, x = np.maximum(least, lo), v.astype(float)
    for place in order:
        rows = np.flatnonzero(lists == place)
        high, low = bounds(v, centres[[place]], np.array([radii[place]]))
        alive = np.flatnonzero((high[row_of, 0] >= least.astype(float)) & (low[row_of, 0] <= hi.astype(float)))
        if not len(rows) or not len(alive):
            continue
        used, at = np.unique(row_of[alive], return_inverse=True)
        scores = exact(x[used], body[rows].astype(float))
        for r, line in zip(alive, at):
            own = scores[line]
            fits = (labels[rows] == label[r]) == same
            keep = np.flatnonzero(fits & (own >= least[r]) & (own <= hi[r]) & (ids[rows] != table[r, 0]))
            if not len(keep):
                continue
            if len(keep) > k:
                keep = keep[own[keep] >= np.partition(own[keep], len(keep) - k)[len(keep) - k]]
            both = found[r] + [(int(own[i]), int(ids[rows[i]])) for i in keep]
            found[r] = sorted(both, key=lambda f: (-f[0], f[1]))[:k]
            if len(found[r]) == k:
                least[r] = max(least[r], found[r][-1][0])
    return found


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); the window of a negative is low to high percent of the positive's score."""
    rows, centres, kind = indexed(taking_part(vectors, scale, id_col, vec_col, label_col), every, PACK)
    one = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v", "region")).alias("one"))
    anchors = checkpoint(one.select(F.col("vec_id").alias("anchor"), "one.*"))
    asked = anchors.select(F.col("label").alias("grp"), "region", "anchor", F.lit(0).alias("nth"), "label", "v", F.lit(-LONG).alias("lo"), F.lit(LONG).alias("hi"))
    found = Search(rows, F.col("label"), centres, kind, True, positives).best(asked)
    chosen = checkpoint(found.where("score >= 0").select(F.col("anchor").alias("anchor_id"), F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    tens = "(positive_score - positive_score % 100) div 100"
    lo = F.expr(f"{tens} * {low} + (positive_score % 100 * {low} + 99) div 100")
    hi = F.expr(f"{tens} * {high} + positive_score % 100 * {high} div 100")
    windows = chosen.select("anchor_id", F.col("place").alias("nth"), lo.alias("lo"), hi.alias("hi"))
    asked = anchors.join(windows, F.expr("anchor = anchor_id")).select(F.lit(0).cast("long").alias("grp"), "region", "anchor", "nth", "label", "v", "lo", "hi")
    met = Search(rows, F.lit(0).cast("long"), centres, kind, False, negatives).best(asked)
    told = met.join(chosen, F.expr("anchor = anchor_id AND nth = place"))
    return told.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
