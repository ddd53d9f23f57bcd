import random

import numpy as np
from llm.conftest import EDGES
from pyspark.sql import functions as F

from catalpa.llm import toxicity


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    plain, bad = ["plain" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(60)], ["vile", "rotten", "foul"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = [rng.choice(plain) for _ in range(30)]
        if toxic:
            text[rng.randrange(30)] = rng.choice(bad).upper()
            text[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(text), "en", "a"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, make):
    rows, labels = corpus()
    docs, marks = make(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs.where("doc_id % 3 <> 1"), marks.where("doc_id % 3 <> 1"))
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    held = [(found[i], y) for i, y in labels if i % 3 == 1]
    assert sum((s >= 0.7) == bool(y) for s, y in held) / len(held) > 0.95
    assert all(s < 0.7 for s, y in held if not y)


def test_risk_gradient_turns_where_the_bracket_is_negative():
    """All of U looks positive: without the correction the negative risk of P would be subtracted without end."""
    p = np.ones((50, 1), dtype=np.float32)
    weights, offset = toxicity.fit_member(p, np.zeros((50, 1), dtype=np.float32), 0.3, steps=200)
    assert np.isfinite(weights).all() and np.isfinite(offset)
    assert toxicity.sigmoid(np.array(weights.sum() + offset)) > 0.7 > toxicity.sigmoid(np.array(offset))


def test_edges(spark, make):
    rows, labels = corpus(200)
    model = toxicity.train(make(rows), spark.createDataFrame([*labels, (0, 0), (0, 1)], "doc_id long, toxic int"))
    docs = make(EDGES, clash=True)
    out = toxicity.score(docs, model)
    assert out.count() == len(EDGES) and all(0 <= r["score"] <= 1 for r in out.collect())
    empty = docs.where("false")
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none is None and {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    nulls = spark.createDataFrame([(None, None), (1, None)], "doc_id long, toxic int")
    assert toxicity.train(docs.select("doc_id", F.col("text")), nulls) is None
