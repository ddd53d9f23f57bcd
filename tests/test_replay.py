"""Replay by identity against a plain run through the operations."""

import random

import pytest

from catalpa.operators.ranges import last_before
from catalpa.plans import replay

SCHEMA = "sch string, kind string, seq long, op string, name string, target string, scope string, members array<string>, attrs string"


def brute(operations):
    out = []
    for place in {(o[0], o[1]) for o in operations}:
        names = {}
        for _, _, seq, op, name, target, scope, members, attrs in sorted((o for o in operations if (o[0], o[1]) == place), key=lambda o: o[2]):
            if op == "CREATE":
                if name in names:
                    continue
                names[name] = {"born": seq, "attrs": "", "all": False, "tables": set(), "schemas": set()}
            one = names.get(name)
            if one is None:
                continue
            one["attrs"] = attrs or one["attrs"]
            if op == "DROP":
                del names[name]
            elif op == "RENAME" and target not in names:
                names[target] = names.pop(name)
            elif op in ("CREATE", "SET"):
                one |= {"all": scope == "all", "tables": set(), "schemas": set()}
                if scope != "all":
                    one[scope] = {m.lower() for m in members}
            elif op in ("ADD", "REMOVE") and not one["all"] and scope != "all":
                one[scope] = one[scope] | {m.lower() for m in members} if op == "ADD" else one[scope] - {m.lower() for m in members}
        out += [(*place, n, o["born"], o["attrs"], o["all"], sorted(o["tables"]), sorted(o["schemas"])) for n, o in names.items()]
    return sorted(out)


def answer(spark, operations):
    return sorted(tuple(r) for r in replay.replayed(spark.createDataFrame(operations, SCHEMA)).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_random_operations(spark, seed):
    rng = random.Random(seed)
    ops = ["CREATE", "CREATE", "DROP", "RENAME", "RENAME", "SET", "ADD", "ADD", "REMOVE", "ALTER"]
    operations = [
        (rng.choice("xy"), rng.choice(["publication", "role"]), seq, rng.choice(ops), rng.choice("abcd"), rng.choice("abcd"), rng.choice(["tables", "tables", "schemas", "all"]), rng.sample(["t", "U", "u", "V"], rng.randrange(4)), rng.choice(["", "", "p", "q"]))
        for seq in range(400)
    ]
    want = brute(operations)
    assert len(want) > 5 and answer(spark, operations) == want


def test_one_identity_through_many_names(spark):
    step = lambda seq, op, name, target="", members=(), scope="tables": ("x", "publication", seq, op, name, target, scope, list(members), "")
    chain = [step(0, "CREATE", "n0", members=["t"]), *[step(i, "RENAME", f"n{i - 1}", f"n{i}") for i in range(1, 60)], step(70, "ADD", "n59", members=["u"]), step(71, "ADD", "n0", members=["v"]), step(72, "RENAME", "n3", "n4"), step(73, "CREATE", "n0")]
    assert answer(spark, chain) == [("x", "publication", "n0", 73, "", False, [], []), ("x", "publication", "n59", 0, "", False, ["t", "u"], [])]
    swap = [step(0, "CREATE", "a", members=["ta"]), step(1, "CREATE", "b", members=["tb"]), step(2, "RENAME", "a", "c"), step(3, "RENAME", "b", "a"), step(4, "RENAME", "c", "b"), step(5, "RENAME", "a", "b")]
    assert answer(spark, swap) == [("x", "publication", "a", 1, "", False, ["tb"], []), ("x", "publication", "b", 0, "", False, ["ta"], [])]
    assert answer(spark, []) == []


def test_last_before(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, None, i])) for i in range(200)]
    got = {r["n"]: r["before"] for r in last_before(spark.createDataFrame(rows, "k string, n int, v int"), ["k"], "n", replay.F.col("v"), "before", slices=7).collect()}
    assert got == {n: max((m for j, m, v in rows if j == k and m < n and v is not None), default=None) for k, n, _ in rows}


def test_only_objects_that_changed_are_told_again(spark, monkeypatch):
    step = lambda sch, seq, op, name, target="": (sch, "role", seq, op, name, target, "tables", [], "")
    calm = [step("calm", 0, "CREATE", "a"), step("calm", 1, "RENAME", "a", "b"), step("calm", 2, "CREATE", "c")]
    stirred = [step("stirred", 0, "CREATE", "a"), step("stirred", 1, "CREATE", "b"), step("stirred", 2, "RENAME", "a", "b"), step("stirred", 3, "RENAME", "b", "c")]
    told = []
    kept = replay.last_before
    monkeypatch.setattr(replay, "last_before", lambda df, *rest: told.append({r["sch"] for r in df.select("sch").distinct().collect()}) or kept(df, *rest))
    holds = replay.lasting(spark.createDataFrame(calm + stirred, SCHEMA))
    assert sorted((r["sch"], r["seq"], r["ok"]) for r in holds.collect()) == [("calm", 1, True), ("stirred", 2, False), ("stirred", 3, True)]
    assert told == [{"calm", "stirred"}, {"stirred"}]
