import random

import pytest
from llm.conftest import EDGES

from catalpa.llm import jaccard_join as jj
from catalpa.llm.components import components


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, percent):
    sets = {}
    for i, text, *_ in rows:
        sets.setdefault(i, []).append(shingle_set(text, size))
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return sorted(((str(i), len(shingle_set(t, size)), None if i is None else root(i)) for i, t, *_ in rows), key=str)


def answer(docs, size, percent):
    return sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jj.join(docs, size=size, percent=percent).collect()), key=str)


def near_copies(seed, families=12, each=9):
    """Copies of a text with a few words changed, so that links are close to the bound, and texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([40, 90, 160]))]
        for _ in range(each):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.2:
                text = text[: int(len(text) * 0.9)]
            rows.append(text)
    rows += [passage + [word() for _ in range(rng.randrange(5, 60))] for _ in range(30)]
    rng.shuffle(rows)
    return [(i, " ".join(t), "en", "a") for i, t in enumerate(rows)]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_matches_brute_force(make, monkeypatch, size, percent):
    monkeypatch.setattr(jj, "BLOCK", 3)
    monkeypatch.setattr(jj, "PART", 2)
    rows = near_copies(size)
    docs = make(rows).repartition(5)
    got = answer(docs, size, percent)
    assert got == brute(rows, size, percent)
    assert 40 < len({c for *_, c in got}) < len(rows)


def test_a_chain_and_a_large_family(make, monkeypatch):
    """Each text links with the next only; and many near copies of one text."""
    monkeypatch.setattr(jj, "BLOCK", 16)
    words = [f"c{i}" for i in range(130)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 64]), "en", "a") for i in range(16)]
    rng = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    for k in range(120):
        text = list(base)
        for _ in range(rng.randrange(0, 4)):
            text[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(text), "en", "a"))
    docs = make(rows).repartition(4)
    assert answer(docs, 4, 85) == brute(rows, 4, 85)


def test_edges(make):
    docs = make(EDGES, clash=True)
    assert answer(docs, 4, 85) == brute(EDGES, 4, 85)
    assert jj.join(docs.where("false")).count() == 0
    assert answer(docs.where("doc_id < 4"), 4, 85) == brute(EDGES[:3], 4, 85)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components(links.where("false")).count() == 0


def test_hot_shingles_are_dealt_apart(make, monkeypatch):
    """Shingles met by very many documents: their documents are dealt by salt, and no link is lost."""
    monkeypatch.setattr(jj, "HOT", 10)
    monkeypatch.setattr(jj, "BLOCK", 8)
    monkeypatch.setattr(jj, "PART", 8)
    monkeypatch.setattr(jj, "HEAVY_LEAST", 2)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base[: i % 3], f"x{i}", *base[i % 3 + 1 :]]), "en", "a") for i in range(60)]  # near copies of one text
    rows += [(100 + i, " ".join(base[:39] + [f"y{i}"]), "en", "a") for i in range(20)]
    rows += [(200 + i, f"quite another text number {i} of its own kind here", "en", "a") for i in range(10)]
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(near_copies(3, 4))]
    assert answer(make(rows), 4, 85) == brute(rows, 4, 85)
