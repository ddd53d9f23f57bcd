"""Language ID by string kernels.

A text is the set of its character n-grams of 1 to SPECTRUM letters (blended spectrum, presence kernel): lower-cased letters
of a learned alphabet, one code for all other letters, one for whatever lies between words. The kernel of two texts is the
share of common n-grams, |A & B| / sqrt(|A| |B|). Nystroem landmarks are whole texts of the training sample; one-versus-rest kernel
ridge regression is solved in the landmarks' space, and a batch of texts is scored by two matrix products.

The classifier learns from at most FIT_PER_LANG different rows of each language (a hash of id and text picks them), none
longer than FIT_CHARS characters; every text is scored whole. Defined cases: null text or text without a letter gives `und` and score 0; without any training text every language is
`und`. Ties go to the first language in order. score is the softmax of the regression values at a fixed sharpness. Repeated
ids, null ids and repeated rows are scored each for itself; other columns pass unchanged, whatever their type.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from catalpa.llm.common import col, hashed, with_made

SPECTRUM = 3
ALPHABET = 62
CODES = ALPHABET + 2  # 0: between words, 1: any other letter
POINTS = 0x110000
FIT_PER_LANG = 600
FIT_CHARS = 100_000
LANDMARKS = 240
RIDGE = 1e-4
SHARPNESS = 8.0
BATCH = 256
UNKNOWN = "und"


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def alphabet(texts: list[str]) -> np.ndarray:
    """Code of each code point: the commonest letters have their own."""
    counts = np.zeros(POINTS, dtype=np.int64)
    for text in texts:
        points, times = np.unique(letters(text), return_counts=True)
        counts[points] += times
    is_letter = np.array([chr(i).isalpha() for i in range(POINTS)])
    table = is_letter.astype(np.uint8)
    ranked = [i for i in np.argsort(-counts, kind="stable")[: 4 * ALPHABET] if is_letter[i] and counts[i]][:ALPHABET]
    table[ranked] = np.arange(2, 2 + len(ranked))
    return table


def has_letter(text: str | None) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


def grams(text: str, table: np.ndarray) -> np.ndarray:
    """Distinct n-gram codes of a text, all orders apart."""
    points = letters(text)
    codes = table[points].astype(np.int64)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)  # one code for a run between words
    codes = codes[keep]
    seen = np.zeros(sum(CODES**n for n in range(1, SPECTRUM + 1)), dtype=bool)
    base, key = 0, codes
    for n in range(1, SPECTRUM + 1):
        if n > 1:
            key = key[:-1] * CODES + codes[n - 1 :]
        seen[base + key] = True
        base += CODES**n
    return np.flatnonzero(seen)


@dataclass
class KernelModel:
    table: np.ndarray  # code point -> letter code
    column: np.ndarray  # n-gram -> column of the landmarks' matrix, or -1
    marks: np.ndarray  # (columns, landmarks), presence over the root of the set size
    weights: np.ndarray  # (landmarks, languages)
    langs: list[str]

    def kernel(self, texts: list[str]) -> np.ndarray:
        present = np.zeros((len(texts), self.marks.shape[0]), dtype=np.float32)
        for i, text in enumerate(texts):
            own = grams(text, self.table)
            at = self.column[own]
            present[i, at[at >= 0]] = 1 / np.sqrt(max(1, len(own)))
        return present @ self.marks

    def score(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.weights


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel | None:
    """One-versus-rest kernel ridge regression on Nystroem features; None without texts."""
    langs = sorted(set(labels))
    if not langs:
        return None
    table = alphabet(texts)
    sets = [grams(t, table) for t in texts]
    by_lang = [[i for i, own in enumerate(labels) if own == lang] for lang in langs]
    chosen = [i for own in by_lang for i in own[: max(1, landmarks // len(langs))]]
    used = np.unique(np.concatenate([sets[i] for i in chosen]))
    column = np.full(sum(CODES**n for n in range(1, SPECTRUM + 1)), -1, dtype=np.int32)
    column[used] = np.arange(len(used))
    marks = np.zeros((len(used), len(chosen)), dtype=np.float32)
    for j, i in enumerate(chosen):
        marks[column[sets[i]], j] = 1 / np.sqrt(max(1, len(sets[i])))
    model = KernelModel(table, column, marks, np.zeros((len(chosen), len(langs)), dtype=np.float32), langs)
    kernel = np.concatenate([model.kernel(texts[i : i + BATCH]) for i in range(0, len(texts), BATCH)]).astype(float)
    among = marks.T.astype(float) @ marks
    target = np.array([[1.0 if own == lang else -1.0 for lang in langs] for own in labels])
    share = np.array([len(texts) / (len(langs) * labels.count(own)) for own in labels])[:, None]  # each language counts alike
    normal = kernel.T @ (share * kernel) + ridge * len(texts) * among + 1e-6 * len(texts) * np.eye(len(chosen))
    model.weights = np.linalg.solve(normal, kernel.T @ (share * target)).astype(np.float32)
    return model


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = FIT_PER_LANG) -> KernelModel | None:
    """Fit on at most per_lang texts of each language, of at most FIT_CHARS characters; only text and language are used."""
    rows = docs.where(col(lang_col).isNotNull() & col(text_col).rlike(r"\p{L}") & (F.length(col(text_col)) <= FIT_CHARS))
    rows = rows.select(col(lang_col).alias("lang"), hashed(col(id_col).cast("string"), col(text_col)).alias("h"), col(text_col).alias("text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).select(F.col("lang").alias("l"), (2.0**64 * per_lang / F.col("n")).alias("upto"))
    near = rows.select("lang", "h").join(F.broadcast(sizes), F.expr("lang = l AND h < upto")).select("lang", "h").distinct()  # sizes: a row a language; equal rows count once
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(f"r <= {per_lang}").select("lang", "h")  # of about 2 * per_lang a language
    kept = rows.join(F.broadcast(few), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text").collect()  # few: per_lang pairs a language at most
    kept.sort(key=lambda r: (r["lang"], r["text"]))
    spread = np.random.default_rng(0).permutation(len(kept))  # the first texts of a language become landmarks
    return fit([kept[i]["text"] for i in spread], [kept[i]["lang"] for i in spread])


def predict(docs: DataFrame, model: KernelModel | None, text_col: str = "text", keep_text: bool = False, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with lang_pred and score (in place of columns so named), without the text unless keep_text; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(texts: list[str | None]) -> dict[str, list]:
        model = shared.value
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        ready = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
        for at in range(0, len(ready), BATCH):
            some = ready[at : at + BATCH]
            values = model.score([texts[i] for i in some]) * SHARPNESS
            shares = np.exp(values - values.max(1, keepdims=True))
            shares /= shares.sum(1, keepdims=True)
            for i, share in zip(some, shares):
                names[i], scores[i] = model.langs[int(share.argmax())], float(share.max())
        return {pred_col: names, score_col: scores}

    kept = [c for c in docs.columns if c.lower() not in (pred_col.lower(), score_col.lower()) and (keep_text or c != text_col)]
    return with_made(docs, kept, [text_col], label, {pred_col: StringType(), score_col: DoubleType()})
