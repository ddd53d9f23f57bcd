"""LM scoring by subword lattice likelihood.

Words are scored one by one over the lattice of their pieces: every segmentation of a word (a space and its letters) counts, and a forward
recursion in log space adds them up to the word's marginal probability. Piece weights start from the existing vocabulary's
scores and are re-estimated once from the corpus: the expected counts of pieces over all segmentations of all training words,
smoothed by PRIOR pseudo-counts of the vocabulary's own weights. A text's probability is the product over its words and one end.
Characters without a piece are spelled by bytes of one shared weight.

Beside it stands a base score, add-0.1 smoothed word counts. Words are counted over all documents; the words met most often, at
most HEAD of them, travel to the workers with their scores, all others meet the documents in a join on the word.

Words of LONG_WORD letters or more are summed up each for itself, place by place, so a word of any length takes time in proportion to its length.

Defined cases: null is empty text, which has its end only. Without training documents N is 0, V is 0 and pieces keep the vocabulary's
weights. Rows that repeat an id and its text get equal scores, each row once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalpa.llm.common import arrow_rows, col, gathered, text_batches
from catalpa.llm.pieces import MODEL_PATH, PieceTable, load, of_one_length
from catalpa.session import checkpoint

SMOOTH = 0.1
PRIOR = 1000.0
HEAD = 200_000
FLUSH = 300_000
CHUNK = 20_000
#: Words of so many letters or more are summed up each for itself, by place; shorter ones many of one length at once.
LONG_WORD = 200
LN10 = math.log(10)


def words(text: str | None) -> list[str]:
    """Runs of other than ASCII white space, A-Z lower-cased."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").lower().split()] if isinstance(text, str) else []


@dataclass
class LatticeModel:
    table: PieceTable
    logp: np.ndarray  # by piece; then one byte; then minus infinity for no piece
    end: float = 0.0  # log-probability of the end of a text

    def edges(self, chars: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end place (start, pieces, log-probabilities), for a group of words of one length."""
        into: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(chars.shape[1] + 1)]
        for i, j, at in self.table.spans(chars):
            if j == i + 1:
                spelled = at < 0
                at[spelled] = self.table.size
                into[j].append((i, at, np.where(spelled, utf8_bytes(chars[:, i]), 1) * self.logp[at]))
            else:
                into[j].append((i, at, self.logp[at]))
        return into

    def log_prob(self, texts: list[str]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(texts))
        for at, chars in of_one_length([" " + t if len(t) < LONG_WORD else "" for t in texts], CHUNK):
            out[at] = forward(self.edges(chars), len(at))[-1]
        for at, text in enumerate(texts):
            if len(text) >= LONG_WORD:
                starts, ends, _, scores = self.places(" " + text)
                out[at] = along(starts, ends, scores, len(text) + 1)[-1]
        return out

    def places(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, pieces, log-probabilities) of all pieces in one text, by end."""
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        starts, ends, at = self.table.along(chars)
        spelled = at < 0
        at = np.where(spelled, self.table.size, at)
        return starts, ends, at, np.where(spelled, utf8_bytes(chars[starts]), 1) * self.logp[at]

    def expected(self, texts: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, and of bytes, over all segmentations of the counted words."""
        out = np.zeros(self.table.size + 1)
        for text, count in zip(texts, counts):
            if len(text) >= LONG_WORD:
                starts, ends, piece, scores = self.places(" " + text)
                n = len(text) + 1
                ahead, behind = along(starts, ends, scores, n), along((n - ends)[::-1], (n - starts)[::-1], scores[::-1], n)[::-1]
                use = np.exp(ahead[starts] + scores + behind[ends] - ahead[-1]) * count
                chars = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                out += np.bincount(piece, np.where(piece == self.table.size, utf8_bytes(chars[starts]), 1) * use, minlength=len(out))
        for at, chars in of_one_length([" " + t if len(t) < LONG_WORD else "" for t in texts], CHUNK):
            into = self.edges(chars)
            ahead, behind = forward(into, len(at)), backward(into, len(at))
            pieces, uses = [], []
            for j, ways in enumerate(into):
                for i, piece, score in ways:
                    use = np.exp(ahead[i] + score + behind[j] - ahead[-1]) * counts[at]
                    keep = piece >= 0
                    pieces.append(piece[keep])
                    uses.append(np.where(piece == self.table.size, utf8_bytes(chars[:, j - 1]), 1)[keep] * use[keep])
            out += np.bincount(np.concatenate(pieces), np.concatenate(uses), minlength=len(out))
        return out


def utf8_bytes(chars: np.ndarray) -> np.ndarray:
    return np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4)))


def log_sum(ways: list[np.ndarray]) -> np.ndarray:
    if len(ways) == 1:
        return ways[0]
    top = np.maximum.reduce(ways)
    return top + np.log(sum(np.exp(w - top) for w in ways))


def along(starts: np.ndarray, ends: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Log of the summed weight of all ways from the start of one text to each of its n places; a turn for each place, with its few pieces."""
    order = np.argsort(ends, kind="stable")
    first, begins, said, out = np.searchsorted(ends[order], np.arange(1, n + 2)).tolist(), starts[order].tolist(), scores[order].tolist(), [0.0]
    for j in range(n):
        ways = [out[begins[k]] + said[k] for k in range(first[j], first[j + 1])]
        top = max(ways)
        out.append(top + math.log(sum(math.exp(w - top) for w in ways)))
    return np.array(out)


def forward(into: list, rows: int) -> list[np.ndarray]:
    """Log of the summed weight of all ways from the start to each place."""
    out = [np.zeros(rows)]
    for ways in into[1:]:
        out.append(log_sum([out[i] + score for i, _, score in ways]))
    return out


def backward(into: list, rows: int) -> list[np.ndarray]:
    """Log of the summed weight of all ways from each place to the end."""
    onward: list[list[tuple[int, np.ndarray]]] = [[] for _ in into]
    for j, ways in enumerate(into):
        for i, _, score in ways:
            onward[i].append((j, score))
    out = [np.zeros(rows)] * len(into)
    for i in range(len(into) - 2, -1, -1):
        out[i] = log_sum([out[j] + score for j, score in onward[i]])
    return out


def initial(path: str = MODEL_PATH) -> LatticeModel:
    """The vocabulary with its own scores."""
    vocabulary = load(path)
    pieces = list(vocabulary.ids)
    logp = [vocabulary.logp[vocabulary.ids[p]] for p in pieces]
    return LatticeModel(PieceTable(pieces), np.array([*logp, vocabulary.byte_logp, -np.inf]))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c_train, c_all) over docs(text, learn)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pd.DataFrame:
            every = list(dict.fromkeys([*seen[0], *seen[1]]))
            train = [seen[1][w] for w in every]
            out = pd.DataFrame({"word": every, "c_train": train, "c_all": [seen[0][w] + t for w, t in zip(every, train)]})
            seen[0].clear()
            seen[1].clear()
            return out.astype({"c_train": "int64", "c_all": "int64"})

        for part in batches:
            for text, learn in zip(part["text"], part["learn"]):
                seen[bool(learn)].update(words(text))
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield flush()
        if seen[0] or seen[1]:
            yield flush()

    return text_batches(docs).mapInPandas(count, "word string, c_train long, c_all long").groupBy("word").agg(F.sum("c_train").alias("c_train"), F.sum("c_all").alias("c_all"))


def learned(model: LatticeModel, counts: DataFrame, n_texts: int) -> LatticeModel:
    """Weights re-estimated from the training words' expected piece counts and the texts' ends."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shared.value.table.size + 1)
        for part in gathered(batches, CHUNK):
            for at in range(0, len(part), CHUNK):
                some = part.iloc[at : at + CHUNK]
                total += shared.value.expected(some["word"].tolist(), some["c_train"].to_numpy(float))
        used = np.flatnonzero(total)
        yield pd.DataFrame({"piece": used.astype(np.int32), "uses": total[used]})

    uses = counts.where("c_train > 0").select("word", "c_train").mapInPandas(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()  # a row for each piece of the vocabulary at most
    total = np.zeros(model.table.size + 1)
    for r in uses:
        total[r["piece"]] = r["uses"]
    start = np.exp(model.logp[:-1])
    start[-1] *= 256
    weight = total + PRIOR * start / start.sum()
    end = n_texts + 1.0
    logp = np.log(weight / (weight.sum() + end))
    logp[-1] -= math.log(256)
    return LatticeModel(model.table, np.append(logp, -np.inf), math.log(end / (weight.sum() + end)))


def with_scores(counts: DataFrame, model: LatticeModel) -> DataFrame:
    """counts with lp, the log10 of each word's marginal probability."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in gathered(batches, CHUNK):
            lp = [shared.value.log_prob(part["word"].iloc[at : at + CHUNK].tolist()) for at in range(0, len(part), CHUNK)]
            yield part.assign(lp=np.concatenate(lp) / LN10 if lp else np.empty(0))

    return counts.mapInPandas(each, "word string, c_train long, c_all long, lp double")


def common_words(scored: DataFrame) -> list:
    """At most HEAD of the words met most often."""
    steps = scored.groupBy(F.floor(F.log2("c_all") * 8).alias("step")).agg(F.count("*").alias("k"), F.min("c_all").alias("least")).orderBy(F.desc("step")).collect()  # a few hundred rows at most
    least, total = None, 0
    for s in steps:
        total += s["k"]
        if total > HEAD:
            break
        least = s["least"]
    return [] if least is None else scored.where(F.col("c_all") >= least).collect()


def score(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL_PATH, base_only: bool = False) -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, train_tokens, base_score, score) of every row; learn tells the training rows.

    With base_only no piece weights are learned and no word is summed up over its lattice; there is no score then.
    """
    docs = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), learn.alias("learn"))
    counts = checkpoint(count_words(docs.select("text", "learn")))
    n_texts = docs.where("learn").count()
    known = counts.agg(F.sum("c_train").alias("n"), F.count_if(F.col("c_train") > 0).alias("v")).first()
    n, v = (known["n"] or 0) + n_texts, known["v"] + (n_texts > 0)
    whole = n + SMOOTH * (v + 1)
    model = None if base_only else learned(initial(path), counts, n_texts)
    scored = checkpoint(with_scores(counts, model)) if model else counts.withColumn("lp", F.lit(0.0))
    base = {c: math.log10((c + SMOOTH) / whole) for c in {0, n_texts}}
    head = {r["word"]: (r["lp"], math.log10((r["c_train"] + SMOOTH) / whole), int(r["c_train"] > 0)) for r in common_words(scored)}
    shared = docs.sparkSession.sparkContext.broadcast(head)
    end = (model.end / LN10 if model else 0.0, base[n_texts], int(n_texts > 0))

    kinds = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("learn", pa.bool_()), ("word", pa.string()), ("times", pa.int64()), ("lp0", pa.float64()), ("base0", pa.float64()), ("known0", pa.int64())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with what its common words come to, and rows for its other words."""
        head = shared.value
        for part in batches:
            out: dict[str, list] = {name: [] for name in kinds.names}
            for doc_id, mark, learn, text in zip(*[part.column(c).to_pylist() for c in ("doc_id", "mark", "learn", "text")]):
                own = words(text)
                found = list(map(head.get, own))
                rest = Counter([w for w, f in zip(own, found) if f is None])
                found = [f for f in found if f is not None]
                sums = [math.fsum(x) for x in zip(end, *found)]
                k = len(rest)
                rows = ([doc_id] * (k + 1), [mark] * (k + 1), [learn] * (k + 1), [None, *rest], [1 + len(found), *rest.values()], [sums[0], *[0.0] * k], [sums[1], *[0.0] * k], [int(sums[2]), *[0] * k])
                for name, values in zip(out, rows):
                    out[name] += values
            yield arrow_rows(out, kinds)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "learn", "text")
    rows = text_batches(rows).mapInArrow(parts, "doc_id long, mark long, learn boolean, word string, times long, lp0 double, base0 double, known0 long")
    # A document's own row has a key that no word is (it holds a space), another for each document, so that these rows spread over the tasks.
    rows = rows.withColumn("key", F.coalesce("word", F.concat(F.lit("a "), F.xxhash64("doc_id", "mark").cast("string"))))
    met = rows.join(scored.select(F.col("word").alias("key"), "c_train", "lp"), "key", "left")
    is_word = F.col("word").isNotNull()
    log_base = F.log10((F.col("c_train") + SMOOTH) / F.lit(whole))
    sums = met.groupBy("doc_id", "mark", "learn").agg(
        F.count_if(~is_word).alias("rows"),
        F.sum("times").alias("n_tokens"),
        F.sum(F.when(is_word, F.when(F.col("c_train") > 0, F.col("times")).otherwise(0)).otherwise(F.col("known0"))).alias("n_known"),
        F.sum(F.when(is_word, F.col("times") * log_base).otherwise(F.col("base0"))).alias("base_score"),
        F.sum(F.when(is_word, F.col("times") * F.col("lp")).otherwise(F.col("lp0"))).alias("score"),
    )
    per_row = [(F.col(c) / F.col("rows")).cast("long").alias(c) for c in ("n_tokens", "n_known")]
    per_row += [F.lit(n).cast("long").alias("train_tokens"), *[(F.col(c) / F.col("rows")).alias(c) for c in ("base_score", "score")]]
    once = sums.select("doc_id", "learn", *per_row, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("_"))
    return once.drop("_", *(["score"] if base_only else []))
