import hashlib
import random
import re

import pytest

from catalpa.llm import decontamination as dc
from llm.conftest import EDGES, EMPTY

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    """Every window of every item against every place of every document."""
    held = {}
    for item, text in items:
        own = plain(text)
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            held.setdefault(tuple(own[k : k + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        own, hit, names = plain(text), set(), set()
        for size in {len(w) for w in held}:
            for k in range(len(own) - size + 1):
                if tuple(own[k : k + size]) in held:
                    hit |= set(range(k, k + size))
                    names |= held[tuple(own[k : k + size])]
        starts = sorted(h for h in hit if h - 1 not in hit)
        spans = [(s, next(e for e in range(s, len(own) + 1) if e not in hit)) for s in starts]
        out.append((doc, len(own), len(hit), spans, sorted(names)))
    return sorted(out, key=repr)


def answer(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"]) for r in dc.decontaminate(d, i, **more).collect()), key=repr)


@pytest.mark.parametrize("words", [3, 40])
def test_matches_brute_force(spark, words):
    rng = random.Random(words)
    text = lambda n: " ".join(rng.choice(["Ab", "b", "é", "d9", "語"][: words // 8 + 2]) + str(rng.randrange(words)) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 4, 9, 10, 11, 25]))) for k in range(12)] + [(None, text(12)), (3, text(15))]
    docs = [(k, text(rng.choice([0, 3, 9, 10, 60]))) for k in range(40)]
    docs += [(100 + k, f"{text(5)} ... {t}!! {text(7)}") for k, (_, t) in enumerate(items)] + [(200 + k, " ".join(t.split()[2:])) for k, (_, t) in enumerate(items)]
    docs += [(7, docs[-1][1]), (7, docs[-1][1]), (None, items[0][1]), (None, text(20))]
    assert answer(spark, docs, items) == brute(docs, items)


def test_one_shared_passage(spark):
    """Copies of a passage everywhere, and a window that repeats within its item."""
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(k, f"{k} {passage} {passage} end {k}") for k in range(300)] + [(1000, "one two three four five six seven eight nine"), (1001, "a a a a a a a a a a a a a")]
    items = [(k, passage) for k in range(5)] + [(9, "a " * 11)]
    assert answer(spark, docs, items) == brute(docs, items)


def test_edges(spark, make):
    docs = [r[:2] for r in EDGES]
    items = [(1, None), (2, ""), (3, "One WORD"), (4, "!?"), (5, " ".join(f"w{i % 997}x{i % 13}" for i in range(15000, 15030)))]
    assert answer(spark, docs, items) == brute(docs, items)
    assert answer(spark, docs, EMPTY) == brute(docs, []) and answer(spark, EMPTY, items) == []
    clash = make(EDGES, clash=True)
    odd = clash.withColumn("own", clash["lang"]).withColumn("w", clash["lang"])
    got = dc.digest(dc.decontaminate(odd, spark.createDataFrame(items, "item_id long, text string"))).collect()
    assert len(got) == len(EDGES) and {r["items_sha256"] for r in got if not r["contaminated"]} == {hashlib.sha256(b"").hexdigest()}


def test_no_mask_too_small(spark, monkeypatch):
    """A mask whose slots are all taken lets everything pass, and the answer is the same."""
    monkeypatch.setattr(dc, "LEAST_SLOTS", 64)
    monkeypatch.setattr(dc, "MOST_SLOTS", 64)
    docs = [(k, " ".join(str((k * j) % 17) for j in range(60))) for k in range(1, 30)]
    items = [(k, " ".join(str((k * j) % 17) for j in range(5, 40))) for k in range(1, 30, 3)]
    assert answer(spark, docs, items) == brute(docs, items)
