import re

import pytest
from llm.conftest import EDGES
from pyspark.sql import functions as F

from catalpa.llm import private_data as pd_

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def good(kind, value):
    number = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else True, "card": 16 <= len(number) <= 19 and luhn(number), "phone": 8 <= len(number) <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m.group())]


TEXTS = [
    "mail a.b@c.de and x@y.z_q@w.org, a@b@c.com; no@dot",
    "1.2.3.4.5.6.7.8 and 256.1.1.1 and 0000255.1.2.3 or 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111111",
    "+1 (017) 555-7713 +49 30 1234567 +1 +12 +1234567890123456",
    "é😀 mail ü@x.com a@x.com\n+1 234 567 890 1.1.1.1",
    "9" * 5000 + " " + "a@" * 3000 + " 1." * 2000,
    "a.b-c" * 3000 + "@x.com",
]


def test_base_spans_match_plain_patterns(make):
    docs = make([(i, t, "en", "a") for i, t in enumerate(TEXTS)])
    out = {r["doc_id"]: r for r in pd_.digest(pd_.find(docs)).collect()}
    for i, text in enumerate(TEXTS):
        want = brute(text)
        assert out[i]["spans"].split(",") == (want or [""])
        assert [out[i][f"n_{k}"] for k in pd_.KINDS] == [sum(w.startswith(k) for w in want) for k in pd_.KINDS]


@pytest.fixture(scope="module")
def cued(make):
    """Numbers after a cue word: eight with a plus sign, two without; the same shape elsewhere without the cue."""
    rows = [(i, f"please call hotline: +1 555 010 {1000 + i} today", "en", "a") for i in range(8)]
    rows += [(10, "please call hotline: 555 010 2000 today", "en", "a"), (11, "call hotline: 555-010-2001", "en", "a")]
    rows += [(20 + i, f"the sum of parts {100 + i} 200 300 was {i}", "en", "a") for i in range(8)]
    return make(rows)


def test_patterns_discover_unseen_identifiers(cued):
    out = {r["doc_id"]: r["spans"] for r in pd_.digest(pd_.find(cued)).collect()}
    assert out[10] == "phone:21:33" and out[11] == "phone:14:26"
    assert all(out[i] == f"phone:21:{21 + len('+1 555 010 1000')}" for i in range(8))
    assert not any(out[20 + i] for i in range(8))


def test_masking(make):
    docs = make([(1, "to a@b.co from 1.2.3.4!", "en", "a"), (2, "nothing", "en", "a"), (3, None, "en", "a")])
    found = pd_.find(docs)
    rows = docs.join(found.select("doc_id", "spans"), "doc_id").select("doc_id", pd_.masked(F.col("text"), F.col("spans")).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in rows} == {1: "to [EMAIL] from [IP]!", 2: "nothing", 3: None}


def test_edges(make):
    docs = make([*EDGES, (1, "x@y.com", "en", "a"), (1, "x@y.com", "en", "a")], clash=True)
    out = pd_.digest(pd_.find(docs)).collect()
    assert len(out) == len(EDGES) + 2
    assert sorted(r["spans"] for r in out if r["doc_id"] == 1) == ["", "email:0:7", "email:0:7"]
    assert pd_.digest(pd_.find(docs.where("false"))).count() == 0


VARIED = "amber birch cedar delta ember fjord grove heath islet jetty knoll ledge".split()


@pytest.mark.parametrize("before, after", [("{} tel: ", ""), ("{} ({}) tel:", " end"), ("{}<call:", "> end"), ("{}" + "x" * 60 + " tel: ", ""), ("電{}話：", "。")])
def test_cues_after_varied_words(make, before, after):
    """A cue of one word, or one glued to the number, finds numbers though the text before it is never the same."""
    cue = [before.format(w, w) for w in VARIED]
    rows = [(i, f"{cue[i]}+1 555 010 {1000 + i}{after}", "en", "a") for i in range(10)]
    rows += [(10 + i, f"{cue[10 + i]}555 010 {2000 + i}{after}", "en", "a") for i in range(2)]
    rows += [(20 + i, f"{w} sums 100 200 {300 + i}{after}", "en", "a") for i, w in enumerate(VARIED)]
    out = {r["doc_id"]: r["spans"] for r in pd_.digest(pd_.find(make(rows))).collect()}
    assert [out[i] for i in (10, 11)] == [f"phone:{len(cue[i])}:{len(cue[i]) + 12}" for i in (10, 11)]
    assert not any(out[20 + i] for i in range(len(VARIED)))


def test_a_cue_that_mostly_precedes_other_text_finds_nothing(make):
    rows = [(i, f"{w} tel:+1 555 010 {1000 + i}", "en", "a") for i, w in enumerate(VARIED)]
    rows += [(20, "so tel:555 010 2000", "en", "a")] + [(30 + i, f"{w} tel:none", "en", "a") for i, w in enumerate(VARIED * 2)]
    out = {r["doc_id"]: r["spans"] for r in pd_.digest(pd_.find(make(rows))).collect()}
    assert out[20] == ""


def test_base_spans_alone_take_one_pass(spark):
    """What find says of base spans, without a checkpoint or a shuffle."""
    docs = spark.createDataFrame([(1, "mail a@b.org or 10.0.0.1"), (2, None), (3, "+49 30 1234567, card 4111 1111 1111 1111"), (3, "none")], "doc_id long, text string")
    alone = pd_.digest(pd_.base_only(docs)).drop("spans")
    whole = pd_.digest(pd_.find(docs)).drop("spans")
    assert sorted(alone.collect()) == sorted(whole.collect())
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
