"""Replay of operations on named objects whose names change: what is left at the end, by identity.

Operations are rows (sch, kind, seq, op, name, target, scope, members, attrs); seq is unique in a (sch, kind). CREATE begins an object where its name is free and is skipped
where it isn't; DROP ends it; RENAME gives it the name `target`, if it exists and the target is free; SET puts members of a scope (tables, schemas, all) in place of all others,
ADD and REMOVE change some; ALTER says attributes. Operations on names that don't exist are skipped.

Nothing runs row after row. Whether a RENAME holds depends on earlier ones, so all are taken to hold first and told again until none changes, each time only
in a (sch, kind) where one changed: each turn settles at least the earliest that was wrong of each object it touches. Then the time of each name falls into segments; a RENAME points from the segment it begins to the one it
ends, and pointer jumping leads every segment to the CREATE it stems from. Members and attributes are folded by identity with partial aggregates: of what is said after the last SET, the last word on a
member holds.

Defined cases: members are compared without case and told in lower case; after SET of all, ADD and REMOVE change nothing until the next SET; an attribute that is empty says nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalpa.operators.ranges import last_before
from catalpa.plans import generated
from catalpa.session import checkpoint, small

OBJECT = ["sch", "kind"]
NAME = [*OBJECT, "name"]
ENDED = -1


def timeline(operations: DataFrame, holds: DataFrame, begin, end) -> DataFrame:
    """A row for each name an operation touches: (sch, kind, name, seq, op, side, event); side tells the two names of a RENAME, event what happens to the name there, or null."""
    told = operations.join(holds.select(*[F.col(c).alias(f"{c}_") for c in (*OBJECT, "seq")], "ok"), F.expr("sch <=> sch_ AND kind <=> kind_ AND seq = seq_"), "left").drop("sch_", "kind_", "seq_")
    rename = F.col("op") == "RENAME"
    sides = F.when(rename, F.array(F.struct(F.col("name").alias("n"), F.lit("from").alias("side")), F.struct(F.col("target").alias("n"), F.lit("to").alias("side")))).otherwise(F.array(F.struct(F.col("name").alias("n"), F.lit("").alias("side"))))
    each = told.withColumn("x", F.explode(sides)).withColumn("side", F.col("x.side")).withColumn("name", F.col("x.n"))
    happens = F.when(F.col("op") == "CREATE", begin).when(F.col("op") == "DROP", end).when(rename & F.col("ok"), F.when(F.col("side") == "from", end).otherwise(begin))
    return each.select(*NAME, "seq", "op", "side", happens.alias("event"))


def lasting(operations: DataFrame) -> DataFrame:
    """(sch, kind, seq, ok) of each RENAME: whether it holds."""
    holds = checkpoint(operations.where("op = 'RENAME'").select(*OBJECT, "seq", (F.col("name") != F.col("target")).alias("ok")))
    lives = operations.where(F.col("op").isin("CREATE", "DROP", "RENAME"))
    settled = None
    while True:
        seen = last_before(timeline(lives, holds, F.lit(True), F.lit(False)), NAME, "seq", F.col("event"), "before").where("side <> ''")
        side = lambda s: F.coalesce(F.bool_or(F.when(F.col("side") == s, F.col("before"))), F.lit(False))
        told = checkpoint(seen.groupBy(*OBJECT, "seq").agg((side("from") & ~side("to") & (F.min("name") != F.max("name"))).alias("ok"), F.bool_or(F.col("event").isNotNull()).alias("was")))
        moved = small(checkpoint(told.where("ok <> was").select(F.col("sch").alias("s"), F.col("kind").alias("k")).distinct()), F.lit(64))
        here = F.expr("sch <=> s AND kind <=> k")
        holds = told.select(*OBJECT, "seq", "ok")
        still = holds.join(moved, here, "left_anti")
        settled = still if settled is None else settled.unionByName(still)
        if moved.isEmpty():
            return settled
        lives, holds = (checkpoint(df.join(moved, here, "left_semi")) for df in (lives, holds))  # an object kind nothing changed in stays as it is


def segments(operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sch, kind, seq, root) of operations on objects that exist then, root the seq of their CREATE; and (sch, kind, name, root) of objects left at the end."""
    holds = lasting(operations)
    lives = timeline(operations, holds, F.lit(True), F.lit(False))
    told = checkpoint(last_before(lives, NAME, "seq", F.col("event"), "before"))
    again = (F.col("op") == "CREATE") & F.coalesce("before", F.lit(False))
    start = F.when(~again, F.when(F.col("event"), F.col("seq")).when(~F.col("event"), F.lit(ENDED)))
    marked = told.withColumns({"start": start, "skipped": again}).drop("before")
    placed = checkpoint(last_before(marked, NAME, "seq", F.col("start"), "segment"))
    moves = placed.where("op = 'RENAME' AND side = 'from' AND start = -1").select(*OBJECT, F.col("seq").alias("at"), F.col("segment").alias("root"))
    jumps = checkpoint(moves)
    while True:  # each segment that a RENAME began leads to the one it ended
        up = jumps.select(F.col("sch").alias("s"), F.col("kind").alias("k"), F.col("at").alias("via"), F.col("root").alias("next"))
        jumped = checkpoint(jumps.join(up, F.expr("sch <=> s AND kind <=> k AND root = via"), "left").select(*OBJECT, "at", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        jumps, done = jumped.drop("moved"), jumped.where("moved").isEmpty()
        if done:
            break
    up = jumps.select(F.col("sch").alias("s"), F.col("kind").alias("k"), "at", "root")
    own = placed.where("side <> 'to' AND NOT skipped").withColumn("of", F.when(F.col("op") == "CREATE", F.col("seq")).otherwise(F.col("segment"))).where(F.col("of") != ENDED)
    rooted = own.join(up, F.expr("sch <=> s AND kind <=> k AND of = at"), "left").select(*OBJECT, "seq", F.coalesce("root", "of").alias("root"))
    last = placed.where("start IS NOT NULL").groupBy(*NAME).agg(F.max_by("start", "seq").alias("of")).where(F.col("of") != ENDED)
    left = last.join(up, F.expr("sch <=> s AND kind <=> k AND of = at"), "left").select(*NAME, F.coalesce("root", "of").alias("root"))
    return checkpoint(rooted), checkpoint(left)


def replayed(operations: DataFrame) -> DataFrame:
    """(sch, kind, name, born, attrs, all_tables, tables, schemas) of the objects left at the end; born is the seq of their CREATE."""
    rooted, left = segments(operations)
    of = rooted.select(F.col("sch").alias("s"), F.col("kind").alias("k"), F.col("seq").alias("at"), "root")
    said = checkpoint(operations.join(of, F.expr("sch <=> s AND kind <=> k AND seq = at")).select(*OBJECT, "root", "seq", "op", "scope", "members", "attrs"))
    key = [*OBJECT, "root"]
    is_set = F.col("op").isin("CREATE", "SET")
    heads = said.groupBy(*key).agg(F.max(F.when(is_set, F.col("seq"))).alias("since"), F.max_by("scope", F.when(is_set, F.col("seq"))).alias("kind_of_set"), F.max_by("attrs", F.when(F.col("attrs") != "", F.col("seq"))).alias("last_attrs"))
    named = heads.select(*[F.col(c).alias(f"{c}_") for c in key], "since", "kind_of_set", "last_attrs")
    here = "sch <=> sch_ AND kind <=> kind_ AND root = root_"
    members = said.where(F.col("op").isin("CREATE", "SET", "ADD", "REMOVE")).join(named, F.expr(here + " AND seq >= since AND kind_of_set <> 'all'"))
    each = members.select(*key, "seq", "op", "scope", F.explode("members").alias("m")).withColumn("m", F.lower("m"))
    held = each.groupBy(*key, "scope", "m").agg(F.max_by("op", "seq").alias("op")).where("op <> 'REMOVE'")
    names = lambda scope: F.array_sort(F.collect_list(F.when(F.col("scope") == scope, F.col("m")))).alias(scope)
    sets = held.groupBy(*[F.col(c).alias(f"{c}_s") for c in key]).agg(names("tables"), names("schemas"))
    none = F.array().cast("array<string>")
    out = left.join(named, F.expr(here)).join(sets, F.expr("sch <=> sch_s AND kind <=> kind_s AND root = root_s"), "left")
    return out.select(*NAME, F.col("root").alias("born"), F.coalesce("last_attrs", F.lit("")).alias("attrs"), (F.col("kind_of_set") == "all").alias("all_tables"), F.coalesce("tables", none).alias("tables"), F.coalesce("schemas", none).alias("schemas"))


#: Operations on a few names of many schemas, forty a schema.
OPERATIONS = f"""SELECT 'g' || {generated.text('k - k % 40')} AS sch, CASE WHEN c % 2 = 0 THEN 'publication' ELSE 'role' END AS kind, k AS seq, {generated.choose('k + c', ('CREATE', 'CREATE', 'DROP', 'RENAME', 'SET', 'ADD', 'ADD', 'REMOVE', 'ALTER', 'CREATE', 'RENAME'))} AS op,
    'n' || {generated.text('c % 5')} AS name, 'n' || {generated.text('k * 7 % 5')} AS target, CASE WHEN c % 13 = 0 THEN 'all' WHEN k % 3 = 0 THEN 'schemas' ELSE 'tables' END AS scope, {generated.choose('c', ('a,B', 'b', 'c,a', 'A,d', ''))} AS listed, {generated.choose('k', ('', 'x', '', 'y'))} AS attrs
    FROM (SELECT o_orderkey AS k, o_custkey AS c FROM {{orders}}) AS o"""


def replay_identities(spark, sf_dir: str) -> DataFrame:
    from catalpa.session import table

    operations = spark.sql(OPERATIONS, orders=table(spark, sf_dir, "orders"))
    operations = operations.withColumn("members", F.filter(F.split("listed", ","), lambda m: m != "")).drop("listed")
    found = replayed(operations)
    return found.select(*NAME, "born", "attrs", "all_tables", F.array_join("tables", ",").alias("tables"), F.array_join("schemas", ",").alias("schemas"))


QUERIES = {"replay_identities": replay_identities}

ORACLES = {
    "replay_identities": f"""
        WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sch, kind ORDER BY seq) AS n FROM ({OPERATIONS.replace("{orders}", "orders")})),
        r AS (
            SELECT sch, kind, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(name VARCHAR, id BIGINT)[]) AS state, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS seq FROM (SELECT DISTINCT sch, kind FROM o)
            UNION ALL SELECT r.sch, r.kind, o.n,
                CASE WHEN op = 'CREATE' AND len(own) = 0 THEN list_append(r.state, {{'name': o.name, 'id': o.seq}})
                     WHEN op = 'DROP' THEN rest
                     WHEN op = 'RENAME' AND len(own) > 0 AND o.name <> target AND len(list_filter(r.state, lambda x: x.name = target)) = 0 THEN list_append(rest, {{'name': target, 'id': own[1].id}})
                     ELSE r.state END,
                CASE WHEN op = 'CREATE' THEN CASE WHEN len(own) = 0 THEN o.seq END ELSE own[1].id END, o.seq
            FROM r JOIN o ON o.sch = r.sch AND o.kind = r.kind AND o.n = r.n + 1, LATERAL (SELECT list_filter(r.state, lambda x: x.name = o.name) AS own, list_filter(r.state, lambda x: x.name <> o.name) AS rest)),
        ends AS (SELECT sch, kind, unnest(state) AS s FROM (SELECT *, row_number() OVER (PARTITION BY sch, kind ORDER BY n DESC) AS back FROM r) WHERE back = 1),
        said AS (SELECT r.id, o.* FROM r JOIN o USING (sch, kind, seq) WHERE r.id IS NOT NULL),
        head AS (SELECT sch, kind, id, max(seq) FILTER (WHERE op IN ('CREATE', 'SET')) AS since, max_by(scope, seq) FILTER (WHERE op IN ('CREATE', 'SET')) AS scope, max_by(attrs, seq) FILTER (WHERE attrs <> '') AS attrs FROM said GROUP BY ALL),
        m AS (SELECT s.sch, s.kind, s.id, s.scope, lower(unnest(string_split(listed, ','))) AS m, op, seq FROM said s JOIN head h USING (sch, kind, id) WHERE seq >= since AND h.scope <> 'all' AND op IN ('CREATE', 'SET', 'ADD', 'REMOVE') AND listed <> ''),
        held AS (SELECT sch, kind, id, scope, m FROM m GROUP BY ALL HAVING max_by(op, seq) <> 'REMOVE'),
        lists AS (SELECT sch, kind, id, string_agg(m, ',' ORDER BY m) FILTER (WHERE scope = 'tables') AS tables, string_agg(m, ',' ORDER BY m) FILTER (WHERE scope = 'schemas') AS schemas FROM held GROUP BY ALL)
        SELECT e.sch, e.kind, s.name AS name, s.id AS born, coalesce(h.attrs, '') AS attrs, h.scope = 'all' AS all_tables, coalesce(tables, '') AS tables, coalesce(schemas, '') AS schemas
        FROM ends e JOIN head h ON h.sch = e.sch AND h.kind = e.kind AND h.id = s.id LEFT JOIN lists l ON l.sch = e.sch AND l.kind = e.kind AND l.id = s.id""",
}
