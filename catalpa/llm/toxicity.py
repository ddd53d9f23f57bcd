"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers in numpy learn from confirmed toxic texts (P) and unlabelled texts (U). With class prior pi and logistic
loss l, the risk is  pi E_P[l(f)] + max(0, E_U[l(-f)] - pi E_P[l(-f)]);  while the bracket is negative its gradient is turned
round, as the non-negative estimator asks. The ensemble's members differ in their share of U; their margins are averaged.

Features are the presence of words (runs of letters, lower-cased) and of stems, chosen by how much commoner they are in P than in U.
The classifiers learn from at most MAX_POSITIVE toxic and MAX_UNLABELLED other rows, picked by a hash of the row; the prior is
the toxic share of all labelled rows allowed for learning. Every text is scored whole.

Defined cases: null is empty text, scored like any other (the classifiers' offsets alone). Without a toxic text to learn
from every score is 0. Repeated label rows of an id count once, as toxic if any of them is; rows that share an id share its
label; equal rows count once in the samples. A row without an id is scored and can be unlabelled text, never toxic text to
learn from. Other columns pass unchanged, whatever their type.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType

from catalpa.llm.common import chosen, col, hashed, with_made
from catalpa.session import checkpoint

MAX_POSITIVE = 4000
MAX_UNLABELLED = 12000
FEATURES = 512
LEAST_TEXTS = 8
MEMBERS = 3
STEPS = 800
RATE = 0.1
DECAY = 1e-5
STEM = 5
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """Words, and the stems (first letters) of longer ones."""
    found = set(WORD.findall(text.lower())) if isinstance(text, str) else set()
    return found | {w[:STEM] + "*" for w in found if len(w) > STEM}


def choose_features(counts: list[tuple[str, int, int]], n_positive: int, n_unlabelled: int, most: int = FEATURES) -> list[str]:
    """Of (word, texts of P with it, texts of U with it), the words commoner in P, by the excess over its standard error."""

    def lift(in_p: int, in_u: int) -> float:
        a, b = in_p / n_positive, (in_u + 0.5) / (n_unlabelled + 1)
        return (a - b) / np.sqrt(b * (1 - min(b, 0.999)) / n_positive + 1e-12)

    ranked = sorted(((lift(in_p, in_u), word) for word, in_p, in_u in counts), key=lambda x: (-x[0], x[1]))
    return [word for z, word in ranked[:most] if z > 4]


def presence(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.float32)
    for i, at in enumerate(rows):
        out[i, at] = 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_member(p: np.ndarray, u: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and offset of one classifier, by Adam on the corrected risk."""
    theta = np.zeros(p.shape[1] + 1, dtype=np.float32)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        fp, fu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
        bracket = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp, gu = -prior * sigmoid(-fp) / len(fp), np.zeros(len(fu))  # the positive part
        np_, nu = -prior * sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)  # the negative part
        gp, gu = (gp + np_, nu) if bracket >= 0 else (-np_, -nu)
        gp, gu = gp.astype(np.float32), gu.astype(np.float32)
        grad = np.append(gp @ p + gu @ u, gp.sum() + gu.sum())
        grad[:-1] += DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


@dataclass
class ToxicModel:
    column: dict[str, int]
    weights: np.ndarray
    offset: float

    def score(self, text: str | None) -> float:
        at = [self.column[w] for w in words(text) if w in self.column]
        return float(sigmoid(np.array(self.weights[at].sum() + self.offset)))


def fit(positive: list[list[int]], unlabelled: list[list[int]], features: list[str], prior: float) -> ToxicModel | None:
    """An ensemble over the feature columns that each text has."""
    if not positive or not unlabelled:
        return None
    prior = min(max(prior, 1e-3), 0.9)
    p, u = presence(positive, len(features)), presence(unlabelled, len(features))
    members = [fit_member(p, u[i::MEMBERS] if len(u) >= 50 * MEMBERS else u, prior) for i in range(MEMBERS)]
    column = {w: i for i, w in enumerate(features)}
    return ToxicModel(column, np.mean([w for w, _ in members], axis=0), float(np.mean([b for _, b in members])))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None) -> ToxicModel | None:
    """Fit on the texts of docs; labels (id, toxic) must already be limited to rows allowed for learning."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("toxic"))
    if prior is None:
        prior = marked.agg(F.avg("toxic")).first()[0] or 0.0
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text")).withColumn("h", hashed("id", "text"))
    toxic = rows.select("id", "h").join(marked.where("toxic = 1").select(col(id_col).alias("id")), "id", "left_semi").select("h")
    few = F.broadcast(chosen(checkpoint(toxic), MAX_POSITIVE).withColumn("is_p", F.lit(True)).unionByName(chosen(rows.select("h"), MAX_UNLABELLED).withColumn("is_p", F.lit(False))))  # so many longs at most
    sample = rows.join(few, "h").dropDuplicates(["h", "is_p"]).select("is_p", "text")
    packed = with_made(sample, ["is_p"], ["text"], lambda texts: {"words": [sorted(words(t)) for t in texts]}, {"words": ArrayType(StringType())})
    packed = checkpoint(packed.where("NOT is_p").unionByName(packed.where("is_p").dropDuplicates(["words"])))  # copies of a toxic text count once
    sizes = packed.agg(F.count_if("is_p").alias("p"), F.count_if(~F.col("is_p")).alias("u")).first()
    if not sizes["p"] or not sizes["u"]:
        return None
    least = max(3, min(LEAST_TEXTS, sizes["p"] // 50))
    counts = packed.select("is_p", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("is_p").alias("p"), F.count_if(~F.col("is_p")).alias("u"))
    commoner = counts.where((F.col("p") >= least) & (F.col("p") * sizes["u"] > F.col("u") * sizes["p"]))  # words of the sample, met in several texts of P
    features = choose_features([tuple(r) for r in commoner.collect()], sizes["p"], sizes["u"])
    column = packed.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(features)})

    def columns(texts: list[list[str]]) -> dict[str, list]:
        return {"at": [sorted(column.value[w] for w in own if w in column.value) for own in texts]}

    held = with_made(packed, ["is_p"], ["words"], columns, {"at": ArrayType(IntegerType())}).collect()  # MAX_POSITIVE + MAX_UNLABELLED rows at most
    sides = {flag: sorted(list(r["at"]) for r in held if r["is_p"] == flag) for flag in (True, False)}
    spread = np.random.default_rng(0).permutation(len(sides[False]))  # members get shares alike, the same on each run
    return fit(sides[True], [sides[False][i] for i in spread], features, prior)


def score(docs: DataFrame, model: ToxicModel | None, text_col: str = "text") -> DataFrame:
    """docs without the text, with score (in place of a column so named); one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: list[str | None]) -> dict[str, list]:
        model = shared.value
        return {"score": [model.score(t) if model else 0.0 for t in texts]}

    kept = [c for c in docs.columns if c != text_col and c.lower() != "score"]
    return with_made(docs, kept, [text_col], judge, {"score": DoubleType()})
