"""Seeds with several unique keys against a plain loop over the rows."""

import random

import pytest

from catalpa.operators import batches, conflicts

SCHEMA = "id int, mail string, slot int, v string"
KEYS = [["id"], ["mail", "slot"]]


def loop(target, seed, update):
    stand, out = [list(r) for r in target], []
    for row in sorted(seed, key=lambda r: (r[4], repr(r[:4]))):
        hits = [s for s in stand if (row[0] is not None and s[0] == row[0]) or (row[1] is not None and row[2] is not None and (s[1], s[2]) == (row[1], row[2]))]
        if not hits:
            stand.append(list(row[:4]))
        elif len(hits) == 1 and update:
            hits[0][3] = row[3]
        out.append((row[4], "refused" if len(hits) > 1 else "met" if hits else "inserted"))
    return sorted(map(tuple, stand), key=repr), sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_if_one_after_another(spark, seed):
    rng = random.Random(seed)
    target = [(i, f"m{i}", i % 3, "old") for i in range(0, 20, 2)] + [(None, None, 1, "odd"), (None, None, 1, "odd")]
    rows = [(rng.choice([None, rng.randrange(40)]), rng.choice([None, f"m{rng.randrange(30)}"]), rng.choice([None, 0, 1, 2]), f"new{n}", n) for n in range(150)]
    t, s = spark.createDataFrame(target, SCHEMA), spark.createDataFrame(rows, SCHEMA + ", place int")
    got = sorted(map(tuple, conflicts.upsert(t, s, KEYS, ["v"], ["place"]).collect()), key=repr)
    want, fates = loop(target, rows, True)
    assert got == want and {f for _, f in fates} == {"inserted", "met", "refused"}
    assert sorted((r["place"], r["outcome"]) for r in conflicts.outcomes(t, s, KEYS, ["place"]).collect()) == fates
    assert sorted(map(tuple, conflicts.insert_ignore(t, s, KEYS, ["place"]).collect()), key=repr) == loop(target, rows, False)[0]


def test_chains_repeats_and_empty(spark):
    """Rows that conflict in a chain: every other one is inserted; equal rows stand once."""
    chain = [(n // 2, f"m{(n + 1) // 2}", 0, f"v{n}", n) for n in range(13)]
    t, s = spark.createDataFrame([], SCHEMA), spark.createDataFrame(chain + [(99, "x", 1, "same", 50)] * 3, SCHEMA + ", place int")
    got = sorted(map(tuple, conflicts.insert_ignore(t, s, KEYS, ["place"]).collect()), key=repr)
    assert got == loop([], chain + [(99, "x", 1, "same", 50)] * 3, False)[0]
    assert conflicts.upsert(t, s.where("false"), KEYS, ["v"], ["place"]).collect() == []


def test_seeds_that_repeat_a_key(spark):
    target = spark.createDataFrame([(1, "one")], "k int, v string")
    seed = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x"), (2, "y"), (None, "n"), (None, "n")], "k int, v string")
    assert sorted(map(tuple, batches.seed_ignore(target, seed, ["k"]).collect()), key=repr) == sorted([(1, "one"), (2, "x"), (None, "n"), (None, "n")], key=repr)
    assert sorted(map(tuple, batches.seed_upsert(target, seed, ["k"], ["v"]).collect()), key=repr) == sorted([(1, "b"), (2, "y"), (None, "n"), (None, "n")], key=repr)
