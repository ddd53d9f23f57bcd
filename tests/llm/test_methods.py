"""What the operators compute inside, against plain formulas."""

import math

import numpy as np
import pytest
from llm.test_string_kernel import corpus

from catalpa.llm import common, mixing, string_kernel, toxicity, url_filter
from catalpa.llm import private_data as pii


def risk(theta, p, u, prior):
    """pi E_P[l(f)] and the bracket E_U[l(-f)] - pi E_P[l(-f)], written out."""
    loss = lambda z: math.log(1 + math.exp(-z))
    f = lambda x: float(np.dot(theta[:-1], x) + theta[-1])
    positive = prior * sum(loss(f(x)) for x in p) / len(p)
    return positive, sum(loss(-f(x)) for x in u) / len(u) - prior * sum(loss(-f(x)) for x in p) / len(p)


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_steps_go_down_the_corrected_risk(prior):
    """Adam with the gradient by differences: down the risk, and where its bracket is below zero, up along the bracket."""
    rng = np.random.default_rng(5)
    p, u = (rng.random((30, 4)) < 0.8).astype(np.float32), (rng.random((50, 4)) < 0.2).astype(np.float32)
    theta = np.array([0, 0, 0, 0, math.log(prior / (1 - prior))])
    m, v, turned = np.zeros(5), np.zeros(5), 0
    for t in range(1, 41):
        below = risk(theta, p, u, prior)[1] < 0
        turned += below
        value = lambda x: -risk(x, p, u, prior)[1] if below else sum(risk(x, p, u, prior))  # noqa: B023, E731
        slope = np.array([(value(theta + 1e-5 * e) - value(theta - 1e-5 * e)) / 2e-5 for e in np.eye(5)])
        slope[:4] += toxicity.DECAY * theta[:4]
        if t == 1:
            slope[-1] = 0  # at the prior's own log odds the offset is at rest
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta - toxicity.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights, offset = toxicity.fit_member(p, u, prior, steps=40)
    assert turned  # some steps met a bracket below zero
    assert np.allclose(weights, theta[:4], atol=0.15) and abs(offset - theta[-1]) < 0.3


def test_ridge_solves_the_weighted_normal_equations():
    rows = corpus(30)
    texts, labels = [r[1] for r in rows], [r[2] for r in rows[:20]] + ["en"] * 10
    model = string_kernel.fit(texts, labels, landmarks=9, ridge=0.01)
    sets = [set(string_kernel.grams(t, model.table).tolist()) for t in texts]
    chosen = [i for lang in model.langs for i in [j for j, own in enumerate(labels) if own == lang][:3]]
    share = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    k = np.array([[share(a, sets[j]) for j in chosen] for a in sets])
    among = np.array([[share(sets[i], sets[j]) for j in chosen] for i in chosen])
    for col, lang in enumerate(model.langs):
        y = np.array([1.0 if own == lang else -1.0 for own in labels])
        w = np.array([len(labels) / (3 * labels.count(own)) for own in labels])
        # The gradient of sum w (y - K a)^2 + ridge n a' M a (and the small fixed ridge) is zero at the solution.
        a = model.weights[:, col].astype(float)
        gradient = k.T @ (w * (k @ a - y)) + 0.01 * len(texts) * among @ a + 1e-6 * len(texts) * a
        assert np.abs(gradient).max() < 1e-3


def test_letters_beyond_the_basic_plane_are_letters():
    table = string_kernel.alphabet(["plain words"])
    assert string_kernel.grams("\U00010400\U00010401", table).tolist() != string_kernel.grams("  ", table).tolist()
    assert table[0x10401] == 1 and table[ord("p")] > 1 and table[ord(" ")] == 0


def test_markov_model_by_recursion():
    texts, order = ["abab", "abba", "b/a"], 2
    model = url_filter.MarkovModel(order).fit(texts)
    seen = {}
    for t in texts:
        padded = "\x02" + t + "\x03"
        for i in range(1, len(padded)):
            for n in range(order + 1):
                if n <= i:
                    seen.setdefault(padded[i - n : i], []).append(padded[i])

    def prob(context, c):
        if context not in seen:
            return prob(context[1:], c) if context else 1 / url_filter.ALPHABET
        lower = prob(context[1:], c) if context else 1 / url_filter.ALPHABET
        kinds, total = len(set(seen[context])), len(seen[context])
        return (seen[context].count(c) + kinds * lower) / (total + kinds)

    for t in ("ab", "abba/", "zzz", ""):
        padded = "\x02" + t + "\x03"
        want = sum(math.log(prob(padded[max(0, i - order) : i], padded[i])) for i in range(1, len(padded)))
        assert model.log_prob(t) == pytest.approx(want)


def test_threshold_has_the_best_balanced_accuracy():
    rng = np.random.default_rng(2)
    for _ in range(30):
        allowed, blocked = (np.round(rng.normal(m, 1, int(rng.integers(1, 9))), 1).tolist() for m in (0.5, -0.5))
        found = url_filter.calibrate(allowed, blocked)
        balanced = lambda t: np.mean([a >= t for a in allowed]) + np.mean([b < t for b in blocked])
        best = max(balanced(t) for t in [*allowed, *blocked, 99.0])
        assert balanced(found) >= best - 1 / min(len(allowed), len(blocked))


def test_samples_are_bounded_with_a_hot_row(spark):
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'x' || id END AS t")
    out = common.bounded_sample(rows, 500)
    first = sorted(map(tuple, out.collect()))
    assert len(first) == len(set(first)) == 500 and first == sorted(map(tuple, common.bounded_sample(rows.repartition(3), 500).collect()))
    assert common.bounded_sample(rows.where("t = 'hot'"), 500).count() == 1 and common.bounded_sample(rows.where("false"), 5).count() == 0


def test_targets_with_null_and_repeated_ids(make):
    rows = [(None, f"word number {i % 4} of ten more or less and so on", "en", "a") for i in range(1000)] + [(5, "the same", "en", "b")] * 600 + [(i, "c c c", "en", "c") for i in range(900)]
    docs = make(rows)
    got = {r["source"]: r for r in mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max", "size": "max", "*": "count"}).collect()}
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"] for r in got.values()) and got["a"]["count(1)"] == 1000
    again = mixing.mix(docs.repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()))


def test_reliability_by_hand(spark):
    """Confidence and trust after each turn, computed by the same rules in plain Python."""
    edges = [("p1", "c1", 0, f"s{i}", 1 + i % 2, True) for i in range(6)] + [("p1", "c1", 0, "new", 2, False), ("p2", "c2", 0, "new", 1, False), ("p2", "c2", 0, "s0", 1, True), ("p1", "c1", 1, "other", 1, False)]
    totals = {"p1": 14, "p2": 2}
    df = spark.createDataFrame(edges, "pattern string, cue string, kind int, value string, c long, seed boolean")
    patterns, instances = pii.reliable(df, spark.createDataFrame(list(totals.items()), "pattern string, total long"))
    trust = {(k, v): float(s) for _, _, k, v, _, s in edges}
    for _ in range(pii.TURNS):
        confidence = {}
        for p, kind in {(e[0], e[2]) for e in edges}:
            own = [e for e in edges if e[0] == p and e[2] == kind]
            if sum(e[5] for e in own) < pii.MIN_SEEDS:
                continue
            good = sum(math.log1p(e[4]) * trust[e[2], e[3]] for e in own)
            every = sum(math.log1p(e[4]) for e in edges if e[0] == p)
            confidence[p, kind] = good / every * min(1, sum(e[4] for e in own) / totals[p])
        trust = {(k, v): 1.0 if s else 1 - math.prod(1 - max(confidence.get((e[0], k), 0) for e in edges if e[1] == cue and e[2] == k and e[3] == v) for cue in {e[1] for e in edges if e[2] == k and e[3] == v}) for _, _, k, v, _, s in edges}
    assert {(r["pattern"], r["kind"]): r["confidence"] for r in patterns.collect()} == pytest.approx(confidence)
    found = {(r["kind"], r["value"]): r["trust"] for r in instances.collect()}
    assert all(found[k] == pytest.approx(v, abs=1e-5) for k, v in trust.items())


def test_very_many_spans_in_one_text(make):
    text = " ".join(f"user{i}@mail{i % 7}.example.com or 10.0.{i % 256}.1" for i in range(3000))
    out = pii.digest(pii.find(make([(1, text, "en", "a")]))).first()
    assert (out["n_email"], out["n_ip"]) == (3000, 3000) and out["spans"].startswith("email:0:") and out["spans"].count(",") == 5999
