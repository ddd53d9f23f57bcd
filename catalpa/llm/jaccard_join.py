"""N-gram Jaccard join with a token-group matrix.

A document's set is its distinct word shingles, as 64-bit hashes (two different shingles of one hash, should that ever be, count as
one). Two documents link when 100 |A & B| >= percent |A | B|.

1. One pass gives each document's set size and digest, and counts shingles that are met again; equal sets form classes.
2. Sets are ordered by those counts, rare shingles first. Linked sets share a shingle among the first n - ceil(n percent / 100) + 1
   (prefix principle; any fixed order is exact, the counts only make the lists short).
3. Documents that share such shingles are partitioned into groups of similar ones: each is compared with the leader it shares
   most with, and linked ones form groups. Inside a group nothing is left to do for connectivity.
4. Between groups, families (documents with the same leader) are cut into blocks. Pairs of a document and a block whose common leading shingles leave no room for a link are dropped. For the others
   the token-group matrix decides: each block of a group holds the union of its members' shingles; a
   document whose overlap with the union is below the overlap any link needs can't link with a member, so the
   block isn't opened. Qualifying blocks are opened and members compared exactly.

All linked pairs are within a group or found in step 4, so components are exact. Nothing is capped: large groups are split into
blocks, many queries of a block into parts, and the documents of a shingle that very many share are dealt by a salt.

Defined cases: null, empty or blank text has an empty set and links with nothing; with fewer words than a shingle has, the whole
sequence is the only one. Rows that share an id are one node; a null id has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalpa.llm.common import arrow_rows, col, text_batches
from catalpa.llm.components import components
from catalpa.session import checkpoint

HEAVY_LEAST = 4
HEAVY_MOST = 300_000
FLUSH = 1_000_000
HOT = 2000
LEADER_SHARE = 20
BLOCK = 256
PART = 256
BROADCAST_ROWS = 500_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Runs of other than ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MULTIPLIER
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    own = words(text)
    if not own:
        return np.empty(0, dtype=np.uint64)
    if len(own) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=len(own))], dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, own), dtype=np.uint64, count=len(own))
    n = len(each) - size + 1
    out = each[:n]
    for k in range(1, size):
        out = mixed(out) + each[k : k + n]
    return np.unique(mixed(out))


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set it links with."""
    return -(-n * percent // 100)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def survey(docs: DataFrame, size: int) -> DataFrame:
    """Rows (is_doc, key, n, digest): every document with its set size and digest; shingles met again within a task, with counts."""

    kinds = pa.schema([("is_doc", pa.bool_()), ("key", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def met_again() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            keep = counts > 1
            n = int(keep.sum())
            return arrow_rows({"is_doc": [False] * n, "key": signed(keys[keep]), "n": counts[keep], "digest": [None] * n}, kinds)

        for part in batches:
            sets = [shingles(t, size) for t in part.column("text").to_pylist()]
            marks = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield arrow_rows({"is_doc": [True] * len(sets), "key": part.column("doc_id"), "n": [len(s) for s in sets], "digest": marks}, kinds)
            held += [s for s in sets if len(s)]
            total += sum(map(len, sets))
            if total > FLUSH:
                yield met_again()
                held, total = [], 0
        yield met_again()

    return text_batches(docs).mapInArrow(look, "is_doc boolean, key long, n long, digest binary")


def common_shingles(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most HEAVY_MOST of the shingles met most often (sorted hashes, counts); they only set the order."""
    counts = checkpoint(seen.where("NOT is_doc").groupBy("key").agg(F.sum("n").alias("c")).where(F.col("c") >= HEAVY_LEAST))
    steps = counts.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("k"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()  # a few hundred rows at most
    least, total = None, 0
    for s in steps:
        total += s["k"]
        if total > HEAVY_MOST:
            break
        least = s["least"]
    rows = counts.where(F.col("c") >= least).collect() if least is not None else []
    keys = np.array([r["key"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["c"] for r in rows], dtype=np.int64)[order]


def counts_of(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How often each shingle was met again, 0 if it isn't common."""
    keys, counts = common
    if not len(keys):
        return np.zeros(len(own), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return np.where(keys[at] == own, counts[at], 0)


def in_order(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A set from rare to common shingles, equal counts by hash."""
    weight = counts_of(own, common)
    return own[np.argsort(weight, kind="stable")] if weight.any() else own


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], size: int, percent: int) -> DataFrame:
    """(h, salt, node, sized): the leading shingles of each document; of equal sets in a task only the first.

    salt deals the documents of a shingle met over HOT times into parts of about HOT; it is 0 for all other shingles. sized is the set's
    size and, in the lower half, the shingle's rank: one number, as these rows are most of what is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[bytes] = set()
        for part in batches:
            found, salts, nodes, sized = [], [], [], []
            for node, text in zip(part["doc_id"], part["text"]):
                own = shingles(text, size)
                if not len(own) or (mark := xxhash.xxh3_128_digest(own.tobytes())) in met:
                    continue
                met.add(mark)
                first = in_order(own, shared.value)[: len(own) - needed(len(own), percent) + 1]
                times = counts_of(first, shared.value)
                found.append(first)
                salts.append(np.where(times > HOT, 1 + int.from_bytes(mark[:4], "big") % (1 + times // HOT), 0).astype(np.int32))
                nodes.append(np.full(len(first), node, dtype=np.int64))
                sized.append((len(own) << 32) + np.arange(1, len(first) + 1, dtype=np.int64))
            if found:
                yield pd.DataFrame({"h": signed(np.concatenate(found)), "salt": np.concatenate(salts), "node": np.concatenate(nodes), "sized": np.concatenate(sized)})

    return text_batches(docs).mapInPandas(lead, "h long, salt int, node long, sized long")


def size_and_rank() -> tuple[Column, Column]:
    return F.shiftright("sized", 32).cast("int").alias("n"), F.col("sized").bitwiseAND(2**32 - 1).cast("int").alias("rank")


def over_parts(rows: DataFrame, of: str, low: str, high: str) -> DataFrame:
    """rows with low and high, the least and greatest value of a column among the rows of the shingle and salt."""
    by_h = Window.partitionBy("h", "salt")
    return rows.withColumns({low: F.min(of).over(by_h), high: F.max(of).over(by_h)})


def over_hot(rows: DataFrame, salted: DataFrame, of: str, low: str, high: str) -> DataFrame:
    """rows with low and high corrected for HOT shingles, whose salted rows (h and the column) are aggregated where they are."""
    hot = checkpoint(salted.groupBy(F.col("h").alias("hot")).agg(F.min(of).alias("hot_low"), F.max(of).alias("hot_high")))
    if hot.isEmpty():
        return rows
    rows = rows.join(F.broadcast(hot), F.expr("salt > 0 AND h = hot"), "left")  # HEAVY_MOST rows at most
    return rows.withColumns({low: F.coalesce("hot_low", low), high: F.coalesce("hot_high", high)}).drop("hot", "hot_low", "hot_high")


def beside(rows: DataFrame, key: str, sizes: DataFrame, name: str) -> DataFrame:
    """rows with the number that sizes (key, number) has for their key, else 1; sizes, which holds none of 1, is broadcast only while it is small."""
    known = checkpoint(sizes.select(F.col(key).alias("_key"), F.col(name).alias("_number")))
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    return rows.join(known, F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce("_number", F.lit(1))).drop("_key", "_number")


def can_link(percent: int) -> Column:
    """Whether k common leading shingles leave room for the overlap that a link needs.

    With one document in the block, what is common beyond the last common leading shingle (ranks i and j) is at most the shorter
    rest of the two sets. With several, it is at most the longer of the two sets' parts behind their leading shingles; the need
    is least at the ends of the range of sizes that can link.
    """
    share, t = percent / (100 + percent), percent / 100
    n = F.col("n").cast("double")
    single = (100 + percent) * (F.col("k") + F.least(F.col("n") - F.col("i"), F.col("least") - F.col("j"))) >= percent * (F.col("n") + F.col("least"))
    ends = (F.greatest(F.col("least").cast("double"), n * t), F.least(F.col("most").cast("double"), n / t))
    several = [F.col("k") + 2 >= share * (n + m) - F.greatest(n, m) * t for m in ends]
    return F.when(F.col("alone"), single).otherwise(several[0] | several[1])


def with_sets(docs: DataFrame, placed: DataFrame, size: int) -> DataFrame:
    """placed (node, key, part, role, grp) with the node's whole set as packed hashes; placed is broadcast only while it is small."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part.drop(columns=["text"]).assign(shingles=[shingles(t, size).tobytes() for t in part["text"]])

    side = F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed
    rows = docs.join(side, docs["doc_id"] == placed["node"]).select("node", "key", "part", "role", "grp", "text")
    return text_batches(rows).mapInPandas(pack, "node long, key long, part long, role boolean, grp long, shingles binary")


def in_parts(ones: DataFrame, others: DataFrame) -> DataFrame:
    """(node, key, part, role, grp) of both sides (node, key, grp): the first (role true) dealt into parts of about PART, the others in each part."""
    parts = checkpoint(ones.groupBy("key").agg(F.ceil(F.count("*") / PART).alias("parts")))
    dealt = beside(ones, "key", parts.where("parts > 1"), "parts").select("node", "key", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), F.lit(True).alias("role"), "grp")
    every = others.join(parts, "key").select("node", "key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("role"), "grp")
    return checkpoint(dealt.unionByName(every))


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Number of common values of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def linked(common: int, n: int, m: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def compare(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the two roles within a (key, part), but for documents of one grp.

    Role false is a block of similar documents (or one leader), role true are the queries. The block's token union bounds a
    query's overlap with any member; only past the bound the block is opened.
    """

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        own = [(node, grp, unpack(s)) for node, grp, s, role in zip(part["node"], part["grp"], part["shingles"], part["role"]) if not role]
        kept = []
        if own:
            union = np.unique(np.concatenate([s for _, _, s in own])) if len(own) > 1 else own[0][2]
            for node, grp, packed, role in zip(part["node"], part["grp"], part["shingles"], part["role"]):
                if not role:
                    continue
                x = unpack(packed)
                if overlap(x, union) < needed(len(x), percent):
                    continue
                kept += [(node, other) for other, theirs, y in own if theirs != grp and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and linked(overlap(x, y), len(x), len(y), percent)]
        return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "part").applyInPandas(meet, "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    docs = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    seen = checkpoint(survey(docs, size))
    rows = seen.where("is_doc").select(F.col("key").alias("doc_id"), "n", "digest")
    common = common_shingles(seen)
    led = over_parts(prefixes(docs.where("doc_id IS NOT NULL"), common, size, percent), "node", "leader", "last")
    led = checkpoint(led.where("leader < last OR salt > 0").drop("last")).withColumn("last", F.col("leader") + 1)
    led = over_hot(led, led.where("salt > 0"), "node", "leader", "last").where("leader < last").select("h", "salt", "node", *size_and_rank(), "leader")
    # The leader with which a document shares most leading shingles, if they are a fair part of them; others are left to the blocks.
    votes = led.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("votes"), F.first("n").alias("n"))
    votes = votes.where(F.col("votes") * 100 >= LEADER_SHARE * (F.col("n") * (100 - percent) / 100 + 1))
    pairs = checkpoint(votes.groupBy("node").agg(F.max(F.struct("votes", (-F.col("leader")).alias("least"))).alias("top")).select("node", (-F.col("top.least")).alias("key")))
    leaders = pairs.select(F.col("key").alias("node"), "key", F.col("key").alias("grp")).distinct()
    found = checkpoint(compare(with_sets(docs, in_parts(pairs.withColumn("grp", F.col("node")), leaders), size), percent))
    groups = components(found)
    # Token-group matrix over families, the documents with one best leader, linked or not. A block is a family, or a part of one.
    member = led.select("node").distinct().join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("grp"))
    member = checkpoint(member.join(pairs.withColumnRenamed("key", "family"), "node", "left").withColumn("family", F.coalesce("family", "node")))
    member = beside(member, "grp", member.groupBy("grp").agg(F.count("*").alias("members")).where("members > 1"), "members")
    member = beside(member, "family", member.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).where("parts > 1"), "parts")
    member = member.withColumn("slot", F.pmod(F.xxhash64("node"), F.col("parts")))
    placed = member.select("node", "grp", F.struct("members", "grp").alias("order"), F.xxhash64("family", "slot").alias("block"))
    alone = placed.groupBy("block").agg((F.count("*") == 1).alias("alone"))  # a block has about BLOCK members at most
    placed = checkpoint(placed.join(alone, "block"))
    # Of two groups the smaller one asks, so a large group's members ask nobody: only those below the shingle's greatest group
    # ask, and only blocks above its least one are asked.
    posted = led.select("h", "salt", "node", "n", "rank").join(placed, "node")
    posting = over_hot(over_parts(posted, "order", "low", "high"), posted.where("salt > 0"), "order", "low", "high")
    posting = checkpoint(posting.where("low < high"))
    asking = posting.where("order < high").select("h", "node", "n", "rank", "order")
    asked = posting.where("order > low")
    blocks = asked.groupBy("h", "block").agg(F.max("order").alias("top"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("rank").alias("place"), F.bool_and("alone").alias("alone"))
    met = asking.join(blocks, "h").where(F.col("order") < F.col("top"))
    met = met.where((F.col("most") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("least") * percent))
    met = met.groupBy("node", "n", "block").agg(F.count("*").alias("k"), F.max("rank").alias("i"), F.max("place").alias("j"), F.min("least").alias("least"), F.max("most").alias("most"), F.bool_and("alone").alias("alone"))
    asks = met.where(can_link(percent)).select("node", F.col("block").alias("key"))
    group_of = placed.select("node", "grp")
    asks = checkpoint(asks.join(group_of, "node"))
    more = checkpoint(compare(with_sets(docs, in_parts(asks, placed.select("node", F.col("block").alias("key"), "grp")), size), percent))
    # Equal sets are one class; links are between classes.
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    classes = checkpoint(classes.select("digest", "first"))
    known = rows.join(classes, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("first"))
    known = checkpoint(known)
    same = known.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    ends = found.unionByName(more)
    ends = ends.join(same.withColumnRenamed("b", "to_a"), "a", "left").select(F.coalesce("to_a", "a").alias("a"), "b")
    ends = ends.join(same.select(F.col("a").alias("b"), F.col("b").alias("to_b")), "b", "left").select("a", F.coalesce("to_b", "b").alias("b"))
    reached = components(ends).select(F.col("node").alias("first"), F.col("component").alias("reach"))
    return known.join(reached, "first", "left").select("doc_id", "n_shingles", F.coalesce("reach", "first").alias("component_id"))
