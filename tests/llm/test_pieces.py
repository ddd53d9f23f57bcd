import math
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.conftest import EDGES, LONG
from pyspark.sql import functions as F

from catalpa.llm import lattice_lm, nbest, pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL_PATH), reason="no vocabulary file")
TEXTS = ["the on\nbe", "", "a  b ", " x", "▁▁a\n\n", "é語😀 z", "a\0b c", "   ", "Hello, world."]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def every(vocabulary, text):
    """(score, ids) of all segmentations."""
    if not text:
        return [(0.0, ())]
    out = []
    for k in range(1, min(len(text), vocabulary.longest) + 1):
        piece = text[:k]
        if piece in vocabulary.ids:
            ids = (vocabulary.ids[piece],)
            score = vocabulary.logp[ids[0]]
        elif k == 1:
            ids = vocabulary.spell(piece)
            score = vocabulary.byte_logp * len(ids)
        else:
            continue
        out += [(score + s, ids + i) for s, i in every(vocabulary, text[k:])]
    return out


def test_n_best_matches_all_segmentations(vocabulary):
    encoder = nbest.Encoder(vocabulary)
    for text in TEXTS[:-1]:
        want = sorted((s for s, _ in every(vocabulary, " " + text)), reverse=True)[:4] if text else [0.0]
        found = encoder.n_best(text, 4)
        assert np.allclose([f[0] for f in found], want)
        assert all(pieces.decode(vocabulary, nbest.unpacked(f[1]).tolist()) == text for f in found)
        assert len({f[1] for f in found}) == len(found)


def test_many_units_at_once_as_one_by_one(vocabulary):
    one, many = nbest.Encoder(vocabulary), nbest.Encoder(vocabulary)
    parts = many.prepare([*TEXTS, LONG])
    assert all(many.n_best(t, 3, p) == one.n_best(t, 3) for t, p in zip([*TEXTS, LONG], parts))


def test_round_trip_of_tables(make):
    docs = make(EDGES, clash=True)
    encoded = nbest.encode(docs)
    back = {(r["doc_id"], r["n_chars"]): r["text"] for r in nbest.decode_rows(encoded).collect()}
    assert back == {(i, len(t or "")): t or "" for i, t, *_ in EDGES}
    assert nbest.encode(docs.where("false")).count() == 0
    digests = nbest.segment_digest(docs).collect()
    assert len(digests) == len(EDGES) and all(r["decodes"] for r in digests)
    full = nbest.segment(docs, n=3).collect()
    assert all(len(r["scores"]) == 1 + len(r["alternatives"]) and r["scores"] == sorted(r["scores"], reverse=True) for r in full)


def test_lattice_probability_and_expected_counts(vocabulary):
    model = lattice_lm.initial()
    number = {i: k for k, i in enumerate(vocabulary.ids.values())}
    words = ["the", "hereon", "éreau", "語x", "a", "😀"]
    want, uses = [], np.zeros(model.table.size + 1)
    for w in words:
        ways = every(vocabulary, " " + w)
        total = math.log(sum(math.exp(s) for s, _ in ways))
        want.append(total)
        for s, ids in ways:
            for i in ids:
                uses[number.get(i, model.table.size)] += 2 * math.exp(s - total)
    assert np.allclose(model.log_prob(words), want)
    assert np.allclose(model.expected(words, np.full(len(words), 2.0)), uses)


def test_long_words_by_place(monkeypatch):
    """A word summed up by place has the probability and the expected pieces that it has among words of its length; a very long one takes no minute."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdei é語😀") for _ in range(n)).replace(" ", "") or "x" for n in (1, 7, 40, 120, 199, 200, 260)] + ["x" * 230]
    model, counts = lattice_lm.initial(), np.arange(1.0, 9.0)
    monkeypatch.setattr(lattice_lm, "LONG_WORD", 10**9)
    want, uses = model.log_prob(words), model.expected(words, counts)
    for least in (1, 50, 200):
        monkeypatch.setattr(lattice_lm, "LONG_WORD", least)
        assert np.allclose(model.log_prob(words), want, rtol=1e-12) and np.allclose(model.expected(words, counts), uses, atol=1e-9)
    began = time.perf_counter()
    long = model.log_prob(["".join(rng.choice("abcdefghijkl0123456789+/") for _ in range(40000))])
    assert np.isfinite(long).all() and time.perf_counter() - began < 10


def base(rows, learn):
    counts, n_texts = Counter(), 0
    for i, text, *_ in rows:
        if learn(i):
            counts.update((text or "").encode().lower().split())
            n_texts += 1
    n, v = sum(counts.values()) + n_texts, len(counts) + (n_texts > 0)
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    return {i: (len(w := (text or "").encode().lower().split()) + 1, sum(counts[x] > 0 for x in w) + (n_texts > 0), n, sum(log(counts[x]) for x in w) + log(n_texts)) for i, text, *_ in rows}


def test_lm_scores(make, monkeypatch):
    monkeypatch.setattr(lattice_lm, "HEAD", 3)  # so that most words meet the documents in the join
    rows = [*[r for r in EDGES if r[0] not in (4,)], (4, "one word", "en", "a"), *[(100 + i, f"the cat sat on mat {i % 4} THE", "en", "a") for i in range(12)]]
    kept = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    docs = make(rows, clash=True)
    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
    out = {r["doc_id"]: r for r in lattice_lm.score(docs, learn).collect()}
    want = base(rows, kept)
    assert len(out) == len(want)
    for i, (tokens, known, n, score) in want.items():
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n) and r["base_score"] == pytest.approx(score)
    assert out[1]["score"] == pytest.approx(out[2]["score"]) and out[6]["score"] < out[100]["score"] < out[1]["score"] < 0
    assert lattice_lm.score(docs.where("false"), learn).count() == 0
    twice = lattice_lm.score(make([EDGES[3], EDGES[3]]), F.lit(True)).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0]["n_tokens"] == 3
    assert lattice_lm.score(make(EDGES), F.lit(False)).where("train_tokens = 0 AND n_known = 0").count() == len(EDGES)


def test_base_scores_alone_need_no_lattice(spark, make, monkeypatch):
    """The counts and base scores are those beside the lattice's score; no piece is weighed for them."""
    docs, learn = make([(i, text, "en", "a") for i, text in enumerate(["a b a", "b c", "", None, "the cat  sat", "B c d"])]), F.col("doc_id") % 2 == 0
    shown = ["doc_id", "learn", "n_tokens", "n_known", "train_tokens", "base_score"]
    want = sorted(map(tuple, lattice_lm.score(docs, learn).select(*shown).collect()))
    for name in ("initial", "learned", "with_scores"):
        monkeypatch.setattr(lattice_lm, name, None)
    out = lattice_lm.score(docs, learn, base_only=True)
    assert out.columns == shown
    got = sorted(map(tuple, out.collect()))
    assert [r[:-1] for r in got] == [r[:-1] for r in want] and np.allclose([r[-1] for r in got], [r[-1] for r in want], rtol=1e-12)
