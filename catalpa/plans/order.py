"""Dependency order of plans of any size: levels by rounds, cycles told by their components.

An object's level is the longest chain of needs below it. Most objects need one other at most: these form trees, and pointer jumping gives each its tree's root and
its height above it in as many rounds as the logarithm of the longest chain. An object that met its root isn't asked again, only answers. Objects on a ring of such objects
are told by its least, which meets itself as soon as the jumps are as long as the ring. Only objects that need two or more are then peeled, one round for each of them on the longest chain
of such objects. What is left stands on a cycle or needs one that does. There, objects that nothing left needs are trimmed, and the rest is split by reach: every object
takes the least one it can reach (forward), and of those that share it, what the owner in turn reaches (backward) is its component.

Rounds join on numbers, hashes of plan and name. That no two objects share one is checked before they are used, and a need is held against the name as well.

The order is level, then name, objects on or behind cycles last, by name. It is numbered by ranges, so no task holds a whole plan.

Defined cases: a need that isn't an object of the plan, or is the object itself, doesn't count; repeated rows count once. A null plan is a plan of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalpa.plans import generated
from catalpa.session import checkpoint, new_folder, remove

#: Seeds tried until no two objects of the input share a number; of a thousand million, one input in forty needs a second.
SEEDS = 8

#: Where a jump ended: at an object without needs, at one with several, on a ring or above one. Null: not yet.
GROUND, MANY, RING = 0, 1, 2

#: Parts of a table that grows by rounds, before they are written as one.
PARTS = 16

folder: ContextVar[str] = ContextVar("folder")


@contextmanager
def run(spark: SparkSession) -> Iterator[None]:
    """A folder for the steps of a run, which is taken away after it; its answer must be checkpointed by then."""
    place = new_folder(spark, "order")
    token = folder.set(place)
    try:
        yield
    finally:
        folder.reset(token)
        remove(spark, place)


def settled(df: DataFrame) -> DataFrame:
    """Written to the run's folder. Spark takes the files' size for its own; its estimate of a join is the product of its sides', so over rounds of joins its digits would double again and again."""
    place = f"{folder.get()}/{uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def number(plan: Column, name: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), plan.isNull(), plan, name.isNull(), name)


def inside(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, plan, name) and (node, needs) of objects (plan, name, needs), node and needs being numbers; rows of (node, needs) may repeat."""
    for seed in range(SEEDS):
        nodes = settled(objects.select(number(F.col("plan"), F.col("name"), seed).alias("node"), "plan", "name").distinct())
        if nodes.groupBy("node").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"two objects share a number under each of {SEEDS} seeds")
    asked = objects.where("needs IS NOT NULL AND NOT name <=> needs")
    asked = asked.select(number(F.col("plan"), F.col("name"), seed).alias("node"), number(F.col("plan"), F.col("needs"), seed).alias("needed"), "plan", "needs")
    known = nodes.select(F.col("node").alias("known"), F.col("plan").alias("p"), F.col("name").alias("n"))
    met = asked.join(known, F.expr("needed = known AND needs = n AND plan <=> p"))
    return nodes, settled(met.select("node", F.col("needed").alias("needs")))


def trees(degrees: DataFrame) -> DataFrame:
    """(node, root, height, state) of nodes with one need: the first node below that has none or several, and which of these it is; of those on or above a ring, state alone counts."""
    ways = degrees.select(F.col("node").alias("at"), F.col("several").alias("forks"))
    first = degrees.where("NOT several").select("node", "root").join(ways, F.col("root") == F.col("at"), "left")
    state = F.when(F.col("at").isNull(), GROUND).when(F.col("forks"), MANY)
    # low is the least node met on the way, the last one included.
    jumped = settled(first.select("node", "root", F.lit(1).cast("long").alias("height"), F.col("root").alias("low"), state.alias("state")))
    done = jumped.where("state IS NOT NULL")
    moving = jumped.where("state IS NULL")
    while not moving.isEmpty():
        up = done.unionByName(moving)
        up = up.select(F.col("node").alias("at"), F.col("root").alias("next"), F.col("height").alias("more"), F.col("low").alias("lower"), F.col("state").alias("told"))
        met, state = moving, F.col("told")
        owners = moving.where("node = low").select(F.col("node").alias("owner"))
        if not owners.isEmpty():  # they met themselves; all that meet them are on their ring or above it
            met = met.join(settled(owners), F.col("low") == F.col("owner"), "left")
            state = F.when(F.col("owner").isNotNull(), RING).otherwise(state)
        met = met.join(up, F.col("root") == F.col("at"))
        jumped = settled(met.select("node", F.col("next").alias("root"), (F.col("height") + F.col("more")).alias("height"), F.least("low", "lower").alias("low"), state.alias("state")))
        done = done.unionByName(jumped.where("state IS NOT NULL"))
        moving = jumped.where("state IS NULL")
    return done.drop("low")


def levels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, level) of every node with needs, null on and above cycles; and the edges between those."""
    degrees = settled(edges.groupBy("node").agg(F.min("needs").alias("root"), (F.min("needs") != F.max("needs")).alias("several")))
    tree = trees(degrees)
    several = settled(degrees.where("several").select("node"))
    foot = tree.unionByName(several.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("height"), F.lit(MANY).alias("state")))
    foot = foot.select(F.col("node").alias("at"), "root", "height", "state")
    many = edges.join(several, "node", "left_semi").distinct().join(foot, F.col("needs") == F.col("at"), "left")
    ground = F.col("at").isNull() | (F.col("state") == GROUND)
    # What stands on the ground has its level: it takes the node's own number, which spreads, for a need that is never asked for.
    needs = F.when(ground, F.col("node")).when(F.col("state") == MANY, F.col("root")).otherwise(F.col("needs"))
    step = F.when(F.col("state") == RING, 1).otherwise(F.coalesce("height", F.lit(0)) + 1)
    waiting = many.select("node", needs.alias("needs"), step.alias("step"), F.when(ground, F.lit(0).cast("long")).alias("level"))
    waiting = waiting.groupBy("node", "needs", "level").agg(F.max("step").alias("step"))
    known: list[DataFrame] = []
    each = Window.partitionBy("node")
    while True:
        left, least = F.count_if(F.col("level").isNull()).over(each), F.max(F.col("level") + F.col("step")).over(each)
        told = settled(waiting.select("*", left.alias("left"), least.alias("least"), F.row_number().over(each.orderBy("needs")).alias("nth")))
        found = told.where("left = 0 AND nth = 1").select("node", F.col("least").alias("level"))
        known.append(found)
        if found.isEmpty():
            break
        if len(known) > PARTS:
            known = [settled(together(known))]
        fresh = found.select(F.col("node").alias("at"), F.col("level").alias("fresh"))
        waiting = told.where("left > 0").join(fresh, F.col("needs") == F.col("at"), "left").select("node", "needs", "step", F.coalesce("level", "fresh").alias("level"))
    base = settled(together(known))
    above = tree.where(F.col("state") == MANY).join(base.select(F.col("node").alias("at"), "level"), F.col("root") == F.col("at"), "left")
    above = settled(above.select("node", (F.col("level") + F.col("height")).alias("level")))
    late = settled(together([tree.where(F.col("state") == RING).select("node"), above.where("level IS NULL").select("node"), told.where("nth = 1").select("node")]))
    grounded = tree.where(F.col("state") == GROUND).select("node", F.col("height").alias("level"))
    level = together([grounded, above.where("level IS NOT NULL"), base, late.withColumn("level", F.lit(None).cast("long"))])
    below = late.select(F.col("node").alias("needs"))
    return level, settled(edges.join(late, "node", "left_semi").join(below, "needs", "left_semi").select("node", "needs").distinct())


def together(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those of nodes that nothing left needs, again and again; a cycle stays whole."""
    while True:
        needed = edges.select(F.col("needs").alias("at")).distinct()
        kept = settled(edges.join(needed, F.col("node") == F.col("at"), "left_semi"))
        if kept.count() == edges.count():
            return kept
        edges = kept


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on cycles: the least node that reaches it and is reached from it."""
    found, edges = None, trimmed(edges)
    while not edges.isEmpty():
        color = settled(edges.select("node").union(edges.select("needs")).distinct().select("node", F.col("node").alias("color")))
        while True:  # the least node each can reach
            below = color.select(F.col("node").alias("at"), F.col("color").alias("seen"))
            least = edges.join(below, F.col("needs") == F.col("at")).groupBy(F.col("node").alias("n")).agg(F.min("seen").alias("seen"))
            moved = settled(color.join(least, F.col("node") == F.col("n"), "left").select("node", F.least("color", "seen").alias("color"), (F.col("seen") < F.col("color")).alias("changed")))
            color = moved.select("node", "color")
            if moved.where("changed").isEmpty():
                break
        a, b = color.select(F.col("node").alias("x"), F.col("color").alias("cx")), color.select(F.col("node").alias("y"), F.col("color").alias("cy"))
        own = settled(edges.join(a, F.col("node") == F.col("x")).join(b, F.col("needs") == F.col("y")).where("cx = cy").select("node", "needs", F.col("cx").alias("color")))
        # The owner of a color is reached from all that have it; what it reaches within the color is on a cycle with it.
        hit = settled(own.where("node = color").select(F.col("color").alias("node"), "color").distinct())
        front = hit
        while not front.isEmpty():
            at = front.select(F.col("node").alias("at"))
            reached = own.join(at, F.col("node") == F.col("at")).select(F.col("needs").alias("node"), "color").distinct()
            front = settled(reached.join(hit.select(F.col("node").alias("h")), F.col("node") == F.col("h"), "left_anti"))
            hit = settled(hit.unionByName(front))
        sized = hit.groupBy("color").agg(F.count("*").alias("size"))
        rings = hit.join(sized.where("size > 1").select(F.col("color").alias("c")), F.col("color") == F.col("c")).select("node", F.col("color").alias("component"))
        found = settled(rings if found is None else found.unionByName(rings))
        done = settled(color.where("node = color").select(F.col("node").alias("d")).union(hit.select("node")).distinct())
        edges = edges.join(done, F.col("node") == F.col("d"), "left_anti").join(done, F.col("needs") == F.col("d"), "left_anti")
        edges = trimmed(settled(edges))
    return found if found is not None else edges.select("node", F.col("needs").alias("component"))


def leveled(objects: DataFrame) -> DataFrame:
    """What order gives, read from the run's folder."""
    nodes, edges = inside(objects)
    level, left = levels(edges)
    ring = settled(components(left)).select(F.col("node").alias("r"), "component")
    named = nodes.join(ring, F.col("node") == F.col("r")).groupBy(F.col("component").alias("c")).agg(F.min("name").alias("least"))
    ring = settled(ring.join(named, F.col("component") == F.col("c")).select("r", F.col("least").alias("component")))
    all_levels = level.select(F.col("node").alias("l"), "level")
    told = nodes.join(all_levels, F.col("node") == F.col("l"), "left").join(ring, F.col("node") == F.col("r"), "left")
    return settled(told.select("plan", "name", F.when(F.col("l").isNotNull(), F.col("level")).otherwise(0).alias("level"), "component"))


def order(objects: DataFrame) -> DataFrame:
    """(plan, name, level, component) of objects (plan, name, needs); level is null on and above cycles, component is the least name of the object's cycle, else null."""
    with run(objects.sparkSession):
        return checkpoint(leveled(objects))


def ranked(found: DataFrame, slices: int | None = None) -> DataFrame:
    """What placed gives, read from the run's folder."""
    slices = slices or 2 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["plan", F.col("level").isNull(), "level", "name"]
    nth = F.monotonically_increasing_id().bitwiseAND(2**33 - 1)  # the row's number in its partition
    cut = settled(found.repartitionByRange(slices, *key).sortWithinPartitions(*key).withColumn("slice", F.spark_partition_id()).withColumn("nth", nth))
    counts = cut.groupBy(F.col("plan").alias("p"), F.col("slice").alias("s")).agg(F.count("*").alias("rows"), F.min("nth").alias("first"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("p").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = settled(counts.select("p", "s", (before - F.col("first") + 1).alias("ahead")))
    return cut.join(ahead, F.expr("plan <=> p AND slice = s")).withColumn("place", F.col("nth") + F.col("ahead")).drop("slice", "nth", "p", "s", "ahead")


def placed(found: DataFrame, slices: int | None = None) -> DataFrame:
    """found with the place, from 1, of each object in its plan: by level, then name, null levels last; numbered by ranges of (plan, level, name)."""
    with run(found.sparkSession):
        return checkpoint(ranked(found, slices))


#: Needs of one large plan: chains of sixteen, each hung on the first object of a chain far below, some objects with two needs, a few rings.
NEEDS = """SELECT 'all' AS plan, 't' || {k} AS name, CASE WHEN k % 16 = 0 THEN CASE WHEN k > 0 THEN 't' || {low} END WHEN k % 1000 = 7 THEN 't' || {next} ELSE 't' || {before} END AS needs FROM {orders}
    UNION ALL SELECT 'all', 't' || {k}, 't' || {second} FROM {orders} WHERE c % 20 = 0 AND k % 16 > 2"""
PLACES = {"k": "k", "low": "k // 80 * 16", "next": "k + 2", "before": "k - 1", "second": "k - 3"}


def needs_sql(spark_side: bool) -> str:
    orders = f"(SELECT o_orderkey AS k, o_custkey AS c FROM {'{orders}' if spark_side else 'orders'}) AS o"
    return NEEDS.format(orders=orders, **{n: generated.text(f"({p})".replace("//", "div") if spark_side else f"({p})") for n, p in PLACES.items()})


def large_plan(spark, sf_dir: str) -> DataFrame:
    from catalpa.session import table

    return spark.sql(needs_sql(True), orders=table(spark, sf_dir, "orders"))


def plan_levels(spark, sf_dir: str) -> DataFrame:
    """One plan of as many objects as there are orders, by level and name, with its cycles."""
    with run(spark):
        found = ranked(leveled(large_plan(spark, sf_dir)))
        return checkpoint(found.select("name", F.coalesce("level", F.lit(-1).cast("long")).alias("level"), F.coalesce("component", F.lit("")).alias("component"), "place"))


QUERIES = {"plan_levels": plan_levels}

#: A walk of so many needs means a cycle: no chain of these plans is as long.
LONGEST = 150
ORACLES = {
    "plan_levels": f"""
        WITH RECURSIVE o AS ({needs_sql(False)}),
        n AS (SELECT DISTINCT name FROM o),
        e AS (SELECT DISTINCT name, needs FROM o WHERE needs IN (SELECT name FROM n) AND needs <> name),
        w AS (SELECT name, 0 AS k FROM n UNION SELECT e.name, w.k + 1 FROM e JOIN w ON e.needs = w.name WHERE w.k < {LONGEST}),
        depth AS (SELECT name, max(k) AS level FROM w GROUP BY name),
        late AS (SELECT e.* FROM e WHERE name IN (SELECT name FROM depth WHERE level = {LONGEST}) AND needs IN (SELECT name FROM depth WHERE level = {LONGEST})),
        reach AS (SELECT name, needs FROM late UNION SELECT r.name, l.needs FROM reach r JOIN late l ON r.needs = l.name),
        ring AS (SELECT a.name, min(least(a.name, a.needs)) AS component FROM reach a JOIN reach b ON a.name = b.needs AND a.needs = b.name GROUP BY a.name)
        SELECT name, CASE WHEN level < {LONGEST} THEN level ELSE -1 END AS level, coalesce(component, '') AS component,
               row_number() OVER (ORDER BY CASE WHEN level < {LONGEST} THEN level ELSE {LONGEST} END, name) AS place
        FROM depth LEFT JOIN ring USING (name)""",
}
