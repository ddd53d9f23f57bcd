"""SentencePiece encoding and decoding with N-best segmentation.

Forward Viterbi scores of the piece lattice are the exact best score from the start to each place. They serve as the heuristic
of an A* search from the end backward, which therefore yields whole segmentations in order of score, best first. The forward
pass also gives, for each unit, how far its second segmentation lies behind its first; only the n - 1 units of a text with the
smallest such gaps can take part in its n best segmentations, so A* opens only those, and a merge of their lists gives the
text's. Units met before are kept in two generations of bounded size.

Defined cases: null is empty text; empty text has no pieces and one segmentation of score 0. A text with fewer than n segmentations
gives all it has. Equal scores keep the order of the search, which is the same on each run. Null and repeated ids and repeated
rows are segmented each for itself; other columns pass unchanged, whatever their type.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType

from catalpa.llm.common import col, with_made
from catalpa.llm.pieces import MODEL_PATH, PieceTable, Vocabulary, decode, load, of_one_length, spelled, units

KEEP = 200_000
KEEP_FIRST = 40_000
CHUNK = 20_000
TOGETHER, TOGETHER_FIRST = 1000, 300
DIGITS = 7
BEST = 4


def forward(vocabulary: Vocabulary, unit: str) -> tuple[list[float], list[int], float]:
    """Best score up to each place, where its last piece starts, and the gap of the second-best segmentation."""
    n, ids, logp, starts, longest = len(unit), vocabulary.ids, vocabulary.logp, vocabulary.starts, vocabulary.longest
    low = float("-inf")
    best, back, second = [0.0] + [low] * n, [0] * (n + 1), [low] * (n + 1)
    for i in range(n):
        here = best[i]
        for j in range(i + 1, min(n, i + longest) + 1):
            piece = unit[i:j]
            at = ids.get(piece)
            if at is None:
                if j == i + 1:
                    score = here + vocabulary.byte_logp * len(piece.encode("utf-8", "surrogatepass"))
                elif piece in starts:
                    continue
                else:
                    break
                if score > best[j]:
                    second[j], best[j], back[j] = best[j], score, i
                elif score > second[j]:
                    second[j] = score
                if piece not in starts:
                    break
                continue
            score = here + logp[at]
            if score > best[j]:
                second[j], best[j], back[j] = best[j], score, i
            elif score > second[j]:
                second[j] = score
    gap, at = float("inf"), n
    while at:
        gap = min(gap, best[at] - second[at])
        at = back[at]
    return best, back, gap


def forward_many(vocabulary: Vocabulary, table: PieceTable, texts: list[str]) -> Iterator[tuple[str, float, float, bytes]]:
    """(unit, score, gap, packed ids) as forward gives them, for many units at once; not of units that bytes must spell."""
    numbers = np.array(list(vocabulary.ids.values()), dtype=np.int32)
    logp = np.append(np.array(vocabulary.logp)[numbers], -np.inf)
    for at, chars in of_one_length(texts, CHUNK):
        rows, n = chars.shape
        into: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
        for i, j, piece in table.spans(chars):
            into[j].append((i, piece))
        best, second = np.zeros((n + 1, rows)), np.full((n + 1, rows), -np.inf)
        back, last = np.zeros((n + 1, rows), dtype=np.int32), np.full((n + 1, rows), -1, dtype=np.int32)
        every = np.arange(rows)
        for j in range(1, n + 1):
            starts, pieces = np.array([i for i, _ in into[j]]), np.array([p for _, p in into[j]])
            ways = best[starts] + logp[pieces]
            top = ways.argmax(0)
            best[j], back[j], last[j] = ways[top, every], starts[top], pieces[top, every]
            if len(ways) > 1:
                ways[top, every] = -np.inf
                second[j] = ways.max(0)
        reached = np.isfinite(best[n])
        gap, place, cuts = np.full(rows, np.inf), np.full(rows, n), []
        with np.errstate(invalid="ignore"):
            while (going := reached & (place > 0)).any():
                gap = np.where(going, np.minimum(gap, best[place, every] - second[place, every]), gap)
                cuts.append(np.where(going, last[place, every], -1))
                place = np.where(going, back[place, every], 0)
        steps = np.array(cuts[::-1]).T if cuts else np.empty((rows, 0), dtype=np.int32)
        ids = numbers[steps[steps >= 0]].tobytes()
        ends = 4 * np.cumsum((steps >= 0).sum(1))
        for row, start, end in zip(np.flatnonzero(reached).tolist(), *((x[reached]).tolist() for x in (np.append(0, ends[:-1]), ends))):
            yield texts[at[row]], float(best[n, row]), float(gap[row]), ids[start:end]


def piece_ids(vocabulary: Vocabulary, piece: str) -> tuple[int, ...]:
    at = vocabulary.ids.get(piece)
    return (at,) if at is not None else vocabulary.spell(piece)


def first_ids(vocabulary: Vocabulary, unit: str, back: list[int]) -> tuple[int, ...]:
    cuts, at = [], len(unit)
    while at:
        cuts.append(at)
        at = back[at]
    out, start = [], 0
    for end in reversed(cuts):
        out += piece_ids(vocabulary, unit[start:end])
        start = end
    return tuple(out)


def search(vocabulary: Vocabulary, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations of a unit, by A* from its end with the forward scores as heuristic.

    Of ways that are equal to DIGITS decimals the one that has come further goes on, so that ties don't spread the search.
    """
    best, back, _ = forward(vocabulary, unit)
    ids, logp = vocabulary.ids, vocabulary.logp
    heap, count, found = [(round(-best[len(unit)], DIGITS), len(unit), 0, 0.0, None)], 0, []
    while heap and len(found) < n:
        _, at, _, done, tail = heapq.heappop(heap)
        if at == 0:
            out = []
            while tail is not None:
                piece, tail = tail
                out += piece_ids(vocabulary, piece)
            found.append((done, tuple(out)))
            continue
        for start in range(max(0, at - vocabulary.longest), at):
            piece = unit[start:at]
            own = ids.get(piece)
            if own is not None:
                score = logp[own]
            elif start == at - 1:
                score = vocabulary.byte_logp * len(piece.encode("utf-8", "surrogatepass"))
            else:
                continue
            if best[start] > float("-inf"):
                count += 1
                heapq.heappush(heap, (round(-(done + score + best[start]), DIGITS), start, count, done + score, (piece, tail)))
    return sorted(found, key=lambda f: -f[0])


class Encoder:
    """Segmentations of texts; each Python worker has one. Piece ids are packed as 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, keep: int = KEEP) -> None:
        self.vocabulary, self.keep = vocabulary, keep
        self.table = PieceTable(list(vocabulary.ids))
        self.new: dict[str, tuple[float, float, bytes]] = {}
        self.old: dict[str, tuple[float, float, bytes]] = {}
        self.lists: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    def unit(self, text: str) -> tuple[float, float, bytes]:
        """(score, gap, ids) of a unit."""
        found = self.new.get(text) or self.old.get(text)
        if found is None:
            best, back, gap = forward(self.vocabulary, text)
            found = (best[-1], gap, packed(first_ids(self.vocabulary, text, back)))
        if len(text) <= 64:
            if len(self.new) >= self.keep:
                self.old, self.new = self.new, {}
            self.new[text] = found
        return found

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """The units of several texts, met at once."""
        parts = [units(t) for t in texts]
        wanted = set(chain.from_iterable(parts))
        missing = wanted.difference(self.new)
        if len(self.new) + len(missing) > self.keep:
            self.old, self.new = self.new, {}
            missing = wanted
        self.new.update({p: self.old[p] for p in missing.intersection(self.old)})
        fresh = [p for p in missing.difference(self.new) if 0 < len(p) <= 64]
        self.new.update({unit: (score, gap, ids) for unit, score, gap, ids in forward_many(self.vocabulary, self.table, fresh)})
        return parts

    def ready(self, texts: Iterable[str | None]) -> list[tuple[str, list[str]]]:
        """(text, units) of each text, null as empty."""
        every = [t if isinstance(t, str) else "" for t in texts]
        return list(zip(every, self.prepare(every)))

    def listed(self, text: str, n: int) -> list[tuple[float, bytes]]:
        found = self.lists.get((text, n))
        if found is None:
            found = [(score, packed(ids)) for score, ids in search(self.vocabulary, text, n)]
            if len(text) <= 64:
                if len(self.lists) >= self.keep // 10:
                    self.lists.clear()
                self.lists[text, n] = found
        return found

    def best(self, parts: list[str]) -> tuple[tuple[float, ...], tuple[float, ...], tuple[bytes, ...]]:
        """The score, gap and ids of each unit."""
        if not parts:
            return (), (), ()
        found = list(map(self.new.get, parts))
        if None in found:
            found = [self.unit(part) if one is None else one for one, part in zip(found, parts)]
        return tuple(zip(*found))

    def encode(self, text: str, parts: list[str] | None = None) -> bytes:
        """Packed ids of the best segmentation."""
        return b"".join(self.best(units(text) if parts is None else parts)[2])

    def n_best(self, text: str, n: int, parts: list[str] | None = None) -> list[tuple[float, bytes, dict[int, bytes]]]:
        """(score, packed ids, units that differ from the best with their ids) of the n best segmentations."""
        parts = units(text) if parts is None else parts
        scores, gaps, ids = self.best(parts)
        total = math.fsum(scores)
        choices: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        for at in np.argsort(np.array(gaps), kind="stable")[: n - 1].tolist():
            if gaps[at] == float("inf"):
                break
            ways = self.listed(parts[at], n)
            choices = heapq.nlargest(n, [(loss + score - ways[0][0], picks + ((at, w),)) for loss, picks in choices for w, (score, _) in enumerate(ways)], key=lambda c: c[0])
        out = []
        for loss, picks in choices:
            changed = {at: self.listed(parts[at], n)[w][1] for at, w in picks if w}
            chosen = list(ids) if changed else ids
            for at, other in changed.items():
                chosen[at] = other
            out.append((total + loss, b"".join(chosen), changed))
        return out


def packed(ids: tuple[int, ...]) -> bytes:
    return array("i", ids).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int32)


ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, vocabulary: Vocabulary, keep: int = KEEP) -> Encoder:
    """The worker's encoder for a vocabulary, kept between tasks; a worker has one at a time."""
    if (path, keep) not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[path, keep] = Encoder(vocabulary, keep)
    return ENCODERS[path, keep]


def segment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = BEST, path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, ids, scores, alternatives): piece ids of the best segmentation, scores of the n best, and the other ones' ids."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def split(texts: list[str | None]) -> dict[str, list]:
        own = encoder(path, shared.value)
        found = [own.n_best(t, n, parts) for t, parts in own.ready(texts)]
        return {"ids": [unpacked(f[0][1]) for f in found], "scores": [[x[0] for x in f] for f in found], "alternatives": [[unpacked(x[1]) for x in f[1:]] for f in found]}

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    ids = ArrayType(IntegerType())
    return with_made(rows, ["doc_id"], ["text"], split, {"ids": ids, "scores": ArrayType(DoubleType()), "alternatives": ArrayType(ids)}, TOGETHER)


def segment_digest(docs: DataFrame, n: int = BEST, path: str = MODEL_PATH) -> DataFrame:
    """Digest of n-best segmentation: n_chars, n_pieces, scores, hashes of the ids, and whether every segmentation decodes to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def split(texts: list[str | None]) -> dict[str, list]:
        own = encoder(path, shared.value)
        out: dict[str, list] = {c: [] for c in DIGEST}
        for text, parts in own.ready(texts):
            found = own.n_best(text, n, parts)
            # The others differ from the best in whole units only, so those are what is left to decode.
            whole = decode(own.vocabulary, unpacked(found[0][1]).tolist()) == text
            whole &= all(spelled(own.vocabulary, unpacked(ids).tolist()) == parts[at] for _, _, changed in found for at, ids in changed.items())
            marks = [hashlib.sha256(ids) for _, ids, _ in found]
            every = hashlib.sha256(b"".join(m.digest() for m in marks)).hexdigest()
            row = (len(text), len(found[0][1]) // 4, len(found), [x[0] for x in found], marks[0].hexdigest(), every, whole)
            for c, value in zip(out, row):
                out[c].append(value)
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_made(rows, ["doc_id"], ["text"], split, DIGEST, TOGETHER)


DIGEST = {"n_chars": LongType(), "n_pieces": LongType(), "n_best": IntegerType(), "scores": ArrayType(DoubleType()), "ids_sha256": StringType(), "n_best_sha256": StringType(), "decodes": BooleanType()}


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL_PATH) -> DataFrame:
    """docs without the text, with ids (best segmentation) and n_pieces, in place of columns so named."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def split(texts: list[str | None]) -> dict[str, list]:
        own = encoder(path, shared.value, KEEP_FIRST)
        ids = [unpacked(own.encode(t, parts)) for t, parts in own.ready(texts)]
        return {"ids": ids, "n_pieces": [len(i) for i in ids]}

    kept = [c for c in docs.columns if c != text_col and c.lower() not in ("ids", "n_pieces")]
    return with_made(docs, kept, [text_col], split, {"ids": ArrayType(IntegerType()), "n_pieces": LongType()}, TOGETHER_FIRST)


def decode_rows(encoded: DataFrame, ids_col: str = "ids", path: str = MODEL_PATH) -> DataFrame:
    """encoded without the ids, with the text they spell, in place of a column so named."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))
    kept = [c for c in encoded.columns if c != ids_col and c.lower() != "text"]
    return with_made(encoded, kept, [ids_col], lambda ids: {"text": [decode(shared.value, i) if i is not None else "" for i in ids]}, {"text": StringType()})
