import random

import numpy as np
from llm.conftest import EDGES

from catalpa.llm import string_kernel as sk

STEMS = {"en": ["the", "ing", "wh", "and"], "de": ["sch", "ung", "ö", "der"], "fr": ["eau", "é", "que", "les"]}


def corpus(n=240, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = sorted(STEMS)[i % 3]
        words = ["".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(40)]
        rows.append((i, " ".join(words), lang, "a"))
    return rows


def test_held_out_accuracy(make):
    docs = make(corpus())
    model = sk.train(docs.where("doc_id % 5 <> 0"), "doc_id", "text", "lang")
    out = sk.predict(docs.where("doc_id % 5 = 0"), model).collect()
    assert out and all(r["lang"] == r["lang_pred"] and r["score"] > 0.5 for r in out)


def test_kernel_is_the_share_of_common_grams():
    rows = corpus(12)
    texts, labels = [r[1] for r in rows], [r[2] for r in rows]
    model = sk.fit(texts, labels, landmarks=12)
    sets = [set(sk.grams(t, model.table).tolist()) for t in texts]
    order = [i for lang in model.langs for i in range(12) if labels[i] == lang]
    want = [[len(a & sets[j]) / (len(a) * len(sets[j])) ** 0.5 for j in order] for a in sets]
    assert np.allclose(model.kernel(texts), want, atol=1e-4)


def test_edges(make):
    model = sk.train(make(corpus(60)), "doc_id", "text", "lang")
    docs = make(EDGES, clash=True)
    out = sk.predict(docs, model).collect()
    assert len(out) == len(EDGES)
    by_id = {r["doc_id"]: r for r in out}
    assert [by_id[i]["lang_pred"] for i in (1, 2, 3, 9)] == ["und"] * 4 and by_id[1]["score"] == 0
    assert by_id[6]["lang_pred"] in model.langs and all(0 <= r["score"] <= 1 for r in out)
    assert sk.predict(docs.where("false"), model).count() == 0
    assert sk.train(docs.where("false"), "doc_id", "text", "lang") is None
    assert {r["lang_pred"] for r in sk.predict(docs, None, keep_text=True).collect()} == {"und"}
    kept = sk.predict(docs, model, keep_text=True, pred_col="__l", score_col="__s")
    assert set(docs.columns) < set(kept.columns)
