import random

import pytest
from llm.conftest import EDGES
from llm.test_string_kernel import corpus

import corpus_pipeline as cp
from catalpa.llm import nbest, pieces


@pytest.fixture(scope="module")
def docs(make):
    rows = corpus(90)
    rng = random.Random(7)
    rows += [(1000 + i, rows[i][1], rows[i][2], "b") for i in range(5)]  # exact copies
    near, apart = rows[9][1].split(), rows[9][1].split()
    near[-2] = "changed"  # 34 of 38 shingles in common: 0.89
    apart[20] = "changed"  # 31 of 41: 0.76, no near copy
    rows += [(2000, " ".join(near), "en", "b"), (2003, " ".join(apart), "en", "b"), (2001, "12345 !!!", None, "a"), (2002, rows[11][1] + " mail me at x.y@z.org", rows[11][2], None)]
    rows += [(3000 + i, " ".join(rng.choice(["the", "wh", "and"]) + rng.choice(["ing", "the"]) for _ in range(30)), None, "c") for i in range(6)]
    return make(rows, clash=True)


def staged(spark, docs):
    out = {}
    for name, stage in cp.STAGES:
        given = docs
        docs = stage(spark, docs, "")
        if name != "encode":
            assert docs.columns == given.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out[name] = docs
    return out


def test_stages(spark, docs):
    out = staged(spark, docs)
    ids = {name: sorted(r["doc_id"] for r in df.select("doc_id").collect()) for name, df in out.items()}
    assert set(ids["language_id"]) == {r["doc_id"] for r in docs.collect()} - {2001}
    assert out["language_id"].where("doc_id = 3000").first()["lang"] == "en"
    gone = set(ids["language_id"]) - set(ids["near_duplicates"])
    assert {1000, 1001, 1002, 1003, 1004, 2000} <= gone and not gone & {*range(90), 2003}
    assert ids["personal_data"] == ids["near_duplicates"]
    masked = out["personal_data"].where("doc_id = 2002").first() if 2002 in ids["personal_data"] else None
    if masked:
        assert masked["text"].endswith("at [EMAIL]") and masked["n_chars"] == len(masked["text"])
    mixed = out["mix_sources"].collect()
    assert {r["doc_id"] for r in mixed} <= set(ids["personal_data"]) and max(ids["mix_sources"].count(i) for i in set(ids["mix_sources"])) <= 3
    vocabulary = pieces.load()
    texts = sorted((r["doc_id"], r["text"]) for r in mixed)
    spelled = sorted((r["doc_id"], pieces.decode(vocabulary, r["ids"])) for r in out["encode"].collect())
    assert texts == spelled and nbest.BEST >= 2


def test_edges_and_empty(spark, make):
    others = [(100 + r[0], *r[1:]) for r in corpus(30)]
    out = staged(spark, make([*EDGES, *others], clash=True))
    assert out["encode"].count() > 0
    kept = [r["doc_id"] for r in out["near_duplicates"].collect()]
    assert kept.count(4) == 1  # one of two equal rows
    assert staged(spark, make([]))["encode"].count() == 0


def test_texts_that_share_an_id_stay(spark, make):
    """Rows are judged by their texts: different ones of one id, or of none, stay; copies go, under whatever ids."""
    texts = [r[1] for r in corpus(12)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (None, texts[3]), (None, texts[4]), (None, texts[4]), (None, texts[2]), (5, texts[0]), *[(7, texts[5])] * 10, (8, texts[6]), (8, texts[5]), (9, None), (9, ""), (9, texts[7])]
    kept = cp.near_duplicates(spark, make([(i, t, "en", "a") for i, t in rows], clash=True), "").collect()
    assert sorted(r["text"] for r in kept if r["text"]) == sorted(texts[:8])
    assert {(r["doc_id"], r["text"]) for r in kept if r["text"] in (texts[1], texts[2], texts[6], texts[7])} == {(1, texts[1]), (2, texts[2]), (8, texts[6]), (9, texts[7])}
    assert sum(r["doc_id"] == 9 for r in kept) == 3 and sum(r["doc_id"] == 7 for r in kept) <= 1
