"""A subword vocabulary with scores, and the lattice of its pieces over a text.

The vocabulary is a SentencePiece model file, whose path is a parameter; it is read, never trained. Merge-ordered scores are
turned into log-probabilities by rank: log p = -log(rank + RANK_OFFSET), normalised. Characters without a piece are spelled by byte
pieces, each as likely as the least likely piece.

A space in a piece is written as a plain space here, so the mark U+2581 in a text is an ordinary character. No piece goes on
over a space or holds a line break; hence a text splits into units (spaces with the word after them, or a line break) whose
lattices are independent, and what is best for the units is best for the text.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

MODEL_PATH = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
RANK_OFFSET = 64
SLOTS = 20
UNIT = re.compile(r" *[^ \n]+|\n| +")


@dataclass
class Vocabulary:
    ids: dict[str, int]  # piece -> id
    logp: list[float]  # by id
    texts: list[bytes]  # by id
    bytes_at: int  # id of byte 0
    byte_logp: float
    longest: int
    starts: set[str]  # all beginnings of pieces

    def spell(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes_at + b for b in char.encode("utf-8", "surrogatepass"))


def load(path: str = MODEL_PATH) -> Vocabulary:
    """Read a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    texts, ids, bytes_at, rank = [b""] * size, {}, None, {}
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:-1], 16)
            texts[i] = bytes([value])
            bytes_at = i - value if bytes_at is None else bytes_at
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            plain = piece.replace("▁", " ")
            if " " in plain.lstrip(" ") or "\n" in plain:
                raise ValueError(f"a piece goes on over a space or line break: {piece!r}")
            ids[plain], texts[i], rank[i] = i, plain.encode("utf-8"), len(rank)
    if bytes_at is None:
        raise ValueError("the vocabulary has no byte pieces")
    weights = [1 / (rank[i] + RANK_OFFSET) if i in rank else 0.0 for i in range(size)]
    least = 1 / (len(rank) + RANK_OFFSET)
    total = sum(weights) + 256 * least
    logp = [math.log((w or least) / total) for w in weights]
    starts = {p[:k] for p in ids for k in range(1, len(p) + 1)}
    return Vocabulary(ids, logp, texts, bytes_at, math.log(least / total), max(map(len, ids)), starts)


def units(text: str) -> list[str]:
    """The text's units after the space that stands before every text; none for empty text."""
    if not text:
        return []
    if "  " in text or "\0" in text or text[0] == " ":
        return UNIT.findall(" " + text)
    return f" {text}".replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")  # the same with empty units between, sooner


def spelled(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    """The characters of piece ids, the space before the text included."""
    texts = vocabulary.texts
    return b"".join([texts[i] for i in ids]).decode("utf-8", "surrogatepass")


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    """The text of piece ids."""
    return spelled(vocabulary, ids)[1:]


class PieceTable:
    """Pieces by a hash of their characters, for whole columns of candidates at once."""

    FACTOR = np.uint64(0x100000001B3)
    SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))

    def __init__(self, pieces: list[str]) -> None:
        self.longest = max(map(len, pieces))
        self.size = len(pieces)  # the next number stands for spelling by bytes, -1 for no piece
        keys = np.array([self.key(np.array([list(map(ord, p))], dtype=np.uint64))[0] for p in pieces], dtype=np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have the same hash")
        self.keys = keys
        self.levels: list[np.ndarray] = []
        left = np.arange(len(keys), dtype=np.int32)
        for spread in self.SPREAD:
            slots = np.full(1 << SLOTS, -1, dtype=np.int32)
            at = (keys[left] * spread) >> np.uint64(64 - SLOTS)
            _, first = np.unique(at, return_index=True)
            slots[at[first]] = left[first]
            self.levels.append(slots)
            left = np.setdiff1d(left, left[first])
            if not len(left):
                break
        if len(left):
            raise ValueError("pieces don't fit their table")

    def key(self, chars: np.ndarray) -> np.ndarray:
        out = np.zeros(len(chars), dtype=np.uint64)
        for c in chars.T:
            out = (out ^ (c + np.uint64(1))) * self.FACTOR
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int32)
        for slots, spread in zip(self.levels, self.SPREAD):
            at = slots[(keys * spread) >> np.uint64(64 - SLOTS)]
            hit = (at >= 0) & (self.keys[np.maximum(at, 0)] == keys)
            out = np.where(hit, at, out)
        return out

    def spans(self, chars: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, piece numbers or -1) of all places in rows of one length, where any row has a piece or for one character."""
        rows, n = chars.shape
        for i in range(n):
            key = np.zeros(rows, dtype=np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                key = (key ^ (chars[:, j - 1] + np.uint64(1))) * self.FACTOR
                at = self.find(key)
                if j == i + 1 or (at >= 0).any():
                    yield i, j, at

    def along(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, piece numbers) of all places of one text, by end; single characters without a piece have -1. Works on all starts of a text at once."""
        n, key, found = len(chars), np.zeros(len(chars), dtype=np.uint64), []
        for size in range(1, min(n, self.longest) + 1):
            key = (key[: n - size + 1] ^ (chars[size - 1 :] + np.uint64(1))) * self.FACTOR
            at = self.find(key)
            starts = np.arange(n) if size == 1 else np.flatnonzero(at >= 0)
            found.append((starts, starts + size, at[starts]))
        starts, ends, at = (np.concatenate(parts) for parts in zip(*found))
        order = np.lexsort((starts, ends))
        return starts[order], ends[order], at[order]


def of_one_length(texts: list[str], chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, characters) of the texts of each length, at most about 16 * chunk characters at a time; no empty texts."""
    lengths = np.array([len(t) for t in texts])
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        for part in np.array_split(at, -(-len(at) * int(n) // (16 * chunk))):
            joined = "".join([texts[i] for i in part]).encode("utf-32-le", "surrogatepass")
            yield part, np.frombuffer(joined, dtype=np.uint32).reshape(len(part), int(n)).astype(np.uint64)
