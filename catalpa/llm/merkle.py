"""Document fingerprints: a Merkle tree over sections, paragraphs and, below them, pieces of sentences.

A section ends after a blank line, a paragraph after a line break, a piece after a sentence end or MAX_PIECE characters.
Pieces put together are the text, so equal roots mean equal texts (up to a 128-bit hash). A fingerprint is
`root:` and the leaf hashes, 8 hex digits each, with `/` between sections and `.` between paragraphs: every inner node can be
rebuilt from it, and `edits` walks down only the branches that differ.

Defined cases: null is empty text; empty text has one empty leaf, likeness 1 to another empty text and 0 to any other.
Likeness is the Dice coefficient of the leaf hashes as multisets. "Next" goes by descending doc_id, rows of one id by a hash of
their text, null ids last; a single document is its own next. Rows that share id and text stay in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalpa.llm.common import arrow_rows, col, hashed, partitions, text_batches

MAX_PIECE = 64
PIECE = re.compile(r"(?:[^.!?\n]{1,%d}[.!?]*|[.!?]{1,%d})[ \t]?\n?|\n" % (MAX_PIECE, MAX_PIECE))
SECTION = re.compile(r"\n[ \t]*\n+")
ROOT_BYTES, LEAF_BYTES = 16, 4


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=ROOT_BYTES).digest()


def tree(text: str) -> list[list[list[bytes]]]:
    """Sections of paragraphs of leaf hashes."""
    sections, at = [], 0
    for end in [m.end() for m in SECTION.finditer(text)] + [len(text)]:
        if end > at or not sections and end == len(text):
            lines = text[at:end].split("\n")
            lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
            sections.append([[digest(p.encode("utf-8", "surrogatepass")) for p in PIECE.findall(line)] for line in lines] or [[digest(b"")]])
            at = end
    return sections


def root_of(sections: list[list[list[bytes]]]) -> bytes:
    """Each node is the hash of a level mark and its children's hashes."""
    return digest(b"R" + b"".join(digest(b"S" + b"".join(digest(b"P" + b"".join(leaves)) for leaves in section)) for section in sections))


def fingerprint(text: str) -> str:
    sections = tree(text)
    leaves = "/".join(".".join("".join(leaf[:LEAF_BYTES].hex() for leaf in paragraph) for paragraph in section) for section in sections)
    return f"{root_of(sections).hex()}:{leaves}"


def leaves_of(mark: str) -> list[str]:
    """The leaf hashes of a fingerprint, in order."""
    leaves = mark.partition(":")[2].replace("/", "").replace(".", "")
    return [leaves[i : i + 2 * LEAF_BYTES] for i in range(0, len(leaves), 2 * LEAF_BYTES)]


def likeness(a: str, b: str) -> float:
    """Dice coefficient of two fingerprints' leaves; 1 exactly if the roots are equal."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return 1.0
    left, right = leaves_of(a), leaves_of(b)
    return min(2 * sum((Counter(left) & Counter(right)).values()) / (len(left) + len(right)), 1 - 1e-9)


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places at which two fingerprints differ; equal branches aren't entered."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    left, right = (x.partition(":")[2].split("/") for x in (a, b))
    found = []
    for i in range(max(len(left), len(right))):
        if i < min(len(left), len(right)) and left[i] == right[i]:
            continue
        p, q = (x[i].split(".") if i < len(x) else [] for x in (left, right))
        found += [(i, j) for j in range(max(len(p), len(q))) if j >= min(len(p), len(q)) or p[j] != q[j]]
    return found


def edited(text: str, following: str) -> str:
    """The last third of the characters replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def above(edges: list[int], x: Column) -> Column:
    """How many of the edges, in descending order, are at least x; by halving, so that many edges cost little."""
    if not edges:
        return F.lit(0)
    every = F.array(*[F.lit(e).cast("long") for e in edges])
    turns = F.array(*[F.lit(2**k) for k in reversed(range(len(edges).bit_length()))])
    return F.aggregate(turns, F.lit(0), lambda n, k: F.when(n + k > len(edges), n).when(F.try_element_at(every, n + k) >= x, n + k).otherwise(n))


def nth(values: list, kind: str, place: Column) -> Column:
    """The value at a place, from 0, of a list with one entry a bucket."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), place) if values else F.lit(None).cast(kind)


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, doc_id, h, text, halo): buckets of descending id; each also holds, as halo, the first row of the next one.

    Texts are shuffled once. The bucket edges are quantiles of the ids. An id (or null) that fills several buckets has its rows dealt
    by h, a hash of the text, which is the order among rows that share an id. What the driver sees is a few numbers a bucket.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text")).withColumn("h", hashed("text"))
    n = max(1, 2 * partitions(docs))
    cuts = rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    often = {int(a) for a, b in zip(cuts, cuts[1:]) if a == b}
    cuts = sorted({int(c) for c in cuts} | {c + 1 for c in often}, reverse=True)  # an id of many rows has a bucket of its own
    rows = rows.withColumn("band", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(above(cuts, F.col("doc_id"))))
    seen = rows.groupBy("band").agg(F.count("*").alias("rows"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()  # at most 2 * n + 1 rows
    share = max(1, sum(r["rows"] for r in seen) // n)
    parts = [0] * (len(cuts) + 2)
    for r in seen:
        parts[r["band"]] = -(-r["rows"] // share) if r["low"] == r["high"] else 1
    within = (F.col("h").cast("double") / 2.0**63 * nth(parts, "int", F.col("band"))).cast("int")
    rows = rows.withColumn("bucket", nth([sum(parts[:b]) for b in range(len(parts))], "int", F.col("band")) + within)
    heads = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", (-F.col("h")).alias("h"))).alias("head")).collect()  # one row a bucket
    heads = sorted((r["bucket"], r["head"]["doc_id"], -r["head"]["h"]) for r in heads)
    known = {b: (doc_id, h, heads[i - 1][0]) for i, (b, doc_id, h) in enumerate(heads)}  # the first bucket's row closes the circle
    doc_ids, hashes, targets = ([known.get(b, (None, None, None))[i] for b in range(sum(parts))] for i in range(3))
    own = F.col("bucket")
    is_first = F.col("doc_id").eqNullSafe(nth(doc_ids, "bigint", own)) & (F.col("h") == nth(hashes, "bigint", own))
    here, there = F.struct(own, F.lit(False).alias("halo")), F.struct(nth(targets, "int", own).alias("bucket"), F.lit(True).alias("halo"))
    dealt = rows.select("doc_id", "h", "text", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))).alias("at"))
    return dealt.select("at.bucket", "doc_id", "h", "text", "at.halo")


KINDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    rows = in_order(docs, id_col, text_col)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, False  # a row waits for the one after it; done: the bucket's halo was used

        def answer(row, text, mark, next_text, next_mark):
            changed = edited(text, next_text)
            own = fingerprint(changed)
            return (row, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mark, own, likeness(mark, own), likeness(mark, next_mark))

        for part in batches:
            out: dict[str, list] = {name: [] for name in KINDS.names}
            for bucket, doc_id, text, halo in zip(*[part.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "halo")]):
                if halo and (done or held is None):
                    continue
                mark = fingerprint(text)
                if held is not None and held[0] == bucket:
                    for name, value in zip(out, answer(held[1], held[2], held[3], text, mark)):
                        out[name].append(value)
                held, done = (None, True) if halo else ((bucket, doc_id, text, mark), False)
            yield arrow_rows(out, KINDS)

    ordered = rows.repartitionByRange(2 * partitions(docs), "bucket").sortWithinPartitions("bucket", "halo", F.col("doc_id").desc_nulls_last(), "h", "text")
    return text_batches(ordered).mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
