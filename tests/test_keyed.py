"""Keyed drift state: restarts, late and repeated batches."""

import random

from catalpa.session import new_folder
from catalpa.streaming import keyed

DESIRED = [("s", "t", "a", "int4", True), ("s", "t", "b", "text", None), ("s", "u", "a", "varchar(5)", False)]


def brute(batches):
    want, state, out = {d[:3]: d[3:] for d in DESIRED}, {}, []
    plain = {"int4": "integer", "int": "integer", "character varying(5)": "varchar(5)"}
    for batch in batches:
        for row in sorted(batch, key=lambda r: r[3]):
            key, (seen, gone, kind, nullable) = row[:3], row[3:]
            last, was = state.get(key, (-1, "unknown"))
            if seen <= last:
                continue
            asked = want.get(key)
            same = asked and plain.get(kind, kind) == plain.get(asked[0], asked[0]) and nullable == asked[1]
            now = ("missing" if asked else "in sync") if gone else "surplus" if not asked else "in sync" if same else "differs"
            if now != was:
                out.append((*key, seen, was, now))
            state[key] = (seen, now)
    return sorted(out)


def test_restarts_late_and_repeated_batches(spark):
    rng = random.Random(2)
    row = lambda seen: ("s", rng.choice("tu"), rng.choice("abc"), seen, rng.random() < 0.2, rng.choice(["int", "integer", "text", "varchar(5)", "character varying(5)", None]), rng.choice([True, False, None]))
    first, second, third = ([row(seen) for seen in range(a, a + 60)] for a in (0, 60, 150))
    late = [row(seen) for seen in range(90, 150)]
    folder, desired = new_folder(spark, "test"), spark.createDataFrame(DESIRED, "sch string, tbl string, col string, data_type string, nullable boolean")
    batches = [first, second, second, third, [*late, *first]]
    for batch in batches:  # each is a run of its own, so the stream starts anew five times
        spark.createDataFrame(batch, keyed.OBSERVED).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(keyed.OBSERVED).parquet(f"{folder}/in")
        keyed.watch(stream, desired, f"{folder}/out", f"{folder}/state").awaitTermination(120)
    got = spark.read.schema(keyed.CHANGES).parquet(f"{folder}/out")
    assert sorted(map(tuple, got.collect())) == brute(batches) and got.count() > 30


def test_columns_share_rows_of_state(spark, monkeypatch):
    """Many columns, also unnamed ones, in few packs: each is followed by itself; an observation without a place changes nothing."""
    monkeypatch.setattr(keyed, "PACKS", 4)
    rng = random.Random(3)
    row = lambda seen: ("s", rng.choice(["t", "u", None]), f"c{rng.randrange(40)}", seen, rng.random() < 0.3, rng.choice(["int", "text"]), True)
    batches = [[row(2**53 + seen) for seen in range(a, a + 200)] for a in (0, 150, 400)]
    folder, desired = new_folder(spark, "test"), spark.createDataFrame(DESIRED, "sch string, tbl string, col string, data_type string, nullable boolean")
    for batch in batches:
        spark.createDataFrame([*batch, ("s", "t", "c1", None, False, "int", True)], keyed.OBSERVED).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(keyed.OBSERVED).parquet(f"{folder}/in")
        keyed.watch(stream, desired, f"{folder}/out", f"{folder}/state").awaitTermination(120)
    named = lambda r: (r[0], r[1] or "~", *r[2:])
    got = [named(tuple(r)) for r in spark.read.schema(keyed.CHANGES).parquet(f"{folder}/out").collect()]
    assert sorted(got) == brute([list(map(named, batch)) for batch in batches]) and len({r[:3] for r in got}) > 100
    assert spark.read.format("statestore").load(f"{folder}/state").count() == 4
