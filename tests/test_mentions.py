"""Names in bodies against regular expressions."""

import random
import re

import pytest

from catalpa.operators import mentions as mn


def brute(bodies, names, quotes):
    out = []
    for i, body in bodies:
        for name in {n for n in names if n}:
            found = [m.start() for m in re.finditer(rf"(?=\b{re.escape(name)}\b)", body or "", re.I | re.A)]
            if quotes:
                found += [m.start() + 1 for m in re.finditer(rf"(?=[\"'`]{re.escape(name)}[\"'`])", body or "", re.I | re.A)]
            if found:
                out.append((i, name, len(set(found))))
    return sorted(out)


def answer(spark, bodies, names, quotes=False):
    b = spark.createDataFrame(bodies, "i int, body string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    return sorted((r["i"], r["name"], r["times"]) for r in mn.mentions(b, n, ["i"], "body", quotes).collect())


NAMES = ["order items", "app.order items", "Order", "items", "a-b", "#x", "x#", "b a", "a  b", "aa", "_a", "é", "l'été", "", None, "items", "a b a"]


@pytest.mark.parametrize(("quotes", "firsts"), [(False, 1000), (True, 1000), (False, 2)])
def test_matches_regular_expressions(spark, monkeypatch, quotes, firsts):
    monkeypatch.setattr(mn, "FIRSTS", firsts)
    rng = random.Random(5)
    pieces = ["order items", "ORDER", "items", "app.", "app.Order Items", "a", "b", " ", " ", "-", "#", "x", '"', "`", "'", "_", "é", "l'été", "\n", "😀"]
    bodies = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(150)] + [(900, None), (901, ""), (902, "order itemsx xorder items"), (903, '"order items" `#x`'), (904, "a b a b a"), (905, "q#x# x#q")]
    want = brute(bodies, NAMES, quotes)
    assert len(want) > 100 and answer(spark, bodies, NAMES, quotes) == want


def test_edges(spark):
    assert answer(spark, [(1, "a b")], []) == [] and answer(spark, [], ["a"]) == [] and answer(spark, [(1, "a b")], [None, ""]) == []
    long = "x " * 20000 + "the end"
    assert answer(spark, [(1, long), (2, "the end"), (2, "the end")], ["the end", "x x"]) == [(1, "the end", 1), (1, "x x", 19999), (2, "the end", 2)]
