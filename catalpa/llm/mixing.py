"""Mixing sources to target weights by entropy balancing.

Sources share all words by weight; no source's target exceeds MAX_COPIES times its size. Document rates r minimise the relative
entropy to one copy each, sum(r log r - r), under a token constraint for each source, sum(r size) = target, and 0 <= r <=
MAX_COPIES. The dual is convex with one multiplier a source: r = min(MAX_COPIES, exp(multiplier * size)). Newton steps, kept inside a
bracket, solve it over (source, size) cells: documents of one source and size have the same rate, so cells hold all that the
gradient needs. Rates are rounded into whole copies cell by cell, along the sizes of a source; a few single swaps then bring
each source's words nearer its target. Within a cell a hash of id and text picks who gets the extra copy; of rows that share
both just as many get it as are missing, so targets are met with null and repeated ids too.

Only DataFrame operations are used. Defined cases: null text has size 0, an empty document is taken 0 words and
kept once; a null source is a source of its own, last in order; a source without words has target 0. Rows that share id and text
may differ by one copy, but as a table the result is the same on each run. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalpa.llm.common import col, fresh, hashed
from catalpa.session import checkpoint

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
STEPS = 60
SOLVED = 1e-9
SWAPS = 6
CELL_BUCKET = 100_000
BROADCAST_CELLS = 200_000


def words(text: Column) -> Column:
    """Number of runs of characters other than space and \\t to \\r."""
    flat = F.coalesce(text, F.lit(""))
    for blank in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size, n): shares by weight, capped, the excess reshared by weight.

    Sources in order of cap over weight are capped first; the level that the rest share is a running total away.
    """
    known = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    cycle = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = known.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1))
    ranked = ranked.withColumn("cap", MAX_COPIES * F.col("source_size").cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = ranked.withColumn("level", (F.sum(F.col("source_size")).over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    ranked = ranked.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return ranked.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def exact_sum(x: Column) -> Column:
    """A sum of decimals, the same in any order."""
    return F.sum(x.cast("decimal(34,8)")).cast("double")


def rate(multiplier: Column, x: Column) -> Column:
    return F.least(F.lit(float(MAX_COPIES)), F.exp(F.least(multiplier * x, F.lit(50.0))))


def solve(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, multiplier, full): Newton on the dual; x is size over the source's mean, full means every rate is the cap."""
    start = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")).join(goals, F.expr("source <=> goal_source")).drop("goal_source")
    state = start.select("source", "mean", "target", "source_size", (F.col("target") >= MAX_COPIES * F.col("source_size") * (1 - 1e-12)).alias("full"), F.lit(0.0).alias("multiplier"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(float("inf")).alias("off"))
    state = checkpoint(state)
    for _ in range(STEPS):
        known = state.select(F.col("source").alias("s"), "mean", "multiplier")
        x, r = F.col("size") / F.col("mean"), rate(F.col("multiplier"), F.col("size") / F.col("mean"))
        sums = cells.where("size > 0").join(known, F.expr("source <=> s")).groupBy("s").agg(exact_sum(F.col("n") * F.col("size") * r).alias("got"), exact_sum(F.when(r < MAX_COPIES, F.col("n") * F.col("size") * x * r).otherwise(0.0)).alias("slope"))
        joined = state.join(sums, F.expr("source <=> s"), "left").drop("s")
        gap = F.coalesce(F.col("got"), F.lit(0.0)) - F.col("target")
        low, high = F.when(gap <= 0, F.col("multiplier")).otherwise(F.col("low")), F.when(gap >= 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - gap / F.col("slope")
        wide = F.when(F.isnan(low) | (low == float("-inf")), high - F.greatest(F.lit(1.0), F.abs(high))).when(high == float("inf"), low + F.greatest(F.lit(1.0), F.abs(low))).otherwise((low + high) / 2)
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high) & (F.abs(newton - F.col("multiplier")) < 8)
        done = F.col("full") | (F.col("target") <= 0) | (F.abs(gap) <= SOLVED * F.col("target"))
        step = F.when(done, F.col("multiplier")).when(inside, newton).otherwise(wide)
        state = checkpoint(joined.select("source", "mean", "target", "source_size", "full", step.alias("multiplier"), low.alias("low"), high.alias("high"), F.when(done, 0.0).otherwise(F.abs(gap) / F.col("target")).alias("off")))
        if (state.agg(F.max("off")).first()[0] or 0.0) <= SOLVED:
            break
    return state.select("source", "mean", "target", "source_size", "full", "multiplier")


def copies_by_cell(cells: DataFrame, solved: DataFrame) -> DataFrame:
    """cells with mean, target, source_size and total, the whole number of copies of the cell's documents together."""
    known = solved.withColumnRenamed("source", "s")
    r = F.when(F.col("full"), float(MAX_COPIES)).when(F.col("size") == 0, 1.0).otherwise(rate(F.col("multiplier"), F.col("size") / F.col("mean")))
    rated = cells.join(known, F.expr("source <=> s")).drop("s").withColumn("due", F.col("n") * r)
    along = Window.partitionBy("source").orderBy("size")  # one row for each size of a source
    upto = F.floor(F.sum("due").over(along) + 0.5 + 1e-9)
    before = F.floor(F.coalesce(F.sum("due").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + 0.5 + 1e-9)
    rounded = checkpoint(rated.withColumn("total", F.greatest(F.lit(0), F.least(MAX_COPIES * F.col("n"), upto - before))).drop("due", "multiplier", "full"))
    for _ in range(SWAPS):
        missing = rounded.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("total"))).alias("missing"))
        up = F.when((F.col("total") < MAX_COPIES * F.col("n")) & (F.col("missing") > 0), F.abs(F.col("missing") - F.col("size")))
        down = F.when((F.col("total") > 0) & (F.col("missing") < 0), F.abs(F.col("missing") + F.col("size")))
        tried = rounded.where("size > 0").join(missing.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")
        tried = tried.withColumn("left", F.coalesce(up, down)).where(F.col("left") < F.abs("missing"))
        swap = tried.groupBy("source").agg(F.min(F.struct("left", "size")).alias("best"), F.first("missing").alias("missing")).select(F.col("source").alias("s"), F.col("best.size").alias("swap_size"), F.signum("missing").cast("long").alias("by"))
        swap = checkpoint(swap)
        if swap.isEmpty():
            break
        changed = rounded.join(swap, F.expr("source <=> s AND size = swap_size"), "left")
        rounded = checkpoint(changed.withColumn("total", F.col("total") + F.coalesce("by", F.lit(0))).drop("s", "swap_size", "by"))
    return rounded


def thresholds(classes: DataFrame, rounded: DataFrame) -> DataFrame:
    """rounded with each (all documents get so many copies), cut (hashes below it get one more) and odd (so many of the hash cut do).

    classes: (source, size, hash, c), rows counted by hash. cut is the k-th smallest hash of the cell, k = total mod n, found in two steps: the
    hashes are dealt by value into buckets of about sqrt(n), at most CELL_BUCKET rows, counted, and only the bucket that holds the k-th is ranked.
    """
    cells = rounded.withColumn("more", F.col("total") % F.col("n")).withColumn("buckets", F.ceil(F.greatest(F.sqrt("n"), F.col("n") / CELL_BUCKET)))
    asked = cells.where("more > 0").select(F.col("source").alias("s"), F.col("size").alias("z"), "more", "buckets")
    place = (F.col("hash").cast("double") / 2.0**63 * F.col("buckets")).cast("long")
    rows = classes.join(asked, F.expr("source <=> s AND size = z")).select("source", "size", "hash", "c", "more", place.alias("bucket"))
    counts = rows.groupBy("source", "size", "bucket").agg(F.sum("c").alias("c"), F.first("more").alias("more"))
    upto = Window.partitionBy("source", "size").orderBy("bucket")  # a row for each bucket
    held = counts.withColumn("upto", F.sum("c").over(upto)).where("upto >= more AND upto - c < more")
    held = held.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b"), (F.col("more") - F.col("upto") + F.col("c")).alias("k"))
    near = rows.join(held, F.expr("source <=> s AND size = z AND bucket = b")).select("source", "size", "hash", "c", "k")
    ranked = near.withColumn("upto", F.sum("c").over(Window.partitionBy("source", "size").orderBy("hash")))  # the rows of one bucket
    cuts = ranked.where("upto >= k AND upto - c < k").select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("hash").alias("cut"), (F.col("k") - F.col("upto") + F.col("c")).alias("odd"), F.col("c").alias("alike"))
    each = F.floor(F.col("total") / F.col("n")).alias("each")
    return cells.join(cuts, F.expr("source <=> s AND size = z"), "left").select("source", "size", "source_size", "target", each, "cut", "odd", "alike")


def numbered(rows: DataFrame, names: list[str], own: list[str]) -> DataFrame:
    """rows with a number (the first name of own) from 1 among the rows alike in the columns names.

    Rows alike are numbered task by task, and each task's numbers go on where those of the tasks before it end.
    """
    number, part, p, offset, *renamed = own
    rows = checkpoint(rows.withColumn(part, F.spark_partition_id()))
    before = Window.partitionBy(*names).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    sizes = rows.groupBy(*names, part).agg(F.count("*").alias(number))
    offsets = sizes.select(*[F.col(n).alias(k) for n, k in zip(names, renamed)], F.col(part).alias(p), F.coalesce(F.sum(number).over(before), F.lit(0)).alias(offset))
    rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(*names, part).orderBy(F.lit(1))))
    joined = rows.join(offsets, [*[F.col(n).eqNullSafe(F.col(k)) for n, k in zip(names, renamed)], F.col(part) == F.col(p)])
    return joined.withColumn(number, F.col(number) + F.col(offset)).drop(*renamed, p, offset, part)


def planned(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of size, source_size, target and copies, and the names these have."""
    own = fresh(docs.columns, "size", "source_size", "target", "copies", "hash", "source", "s", "z", "each", "cut", "odd", "alike", "number", "part", "p", "offset", "k0", "k1", "k2")
    size, source_size, target, copies, h, source, s, z, each, cut, odd, alike, number = own[:13]
    marked = docs.withColumns({source: col(source_col), size: words(col(text_col)), h: hashed(col(id_col).cast("string"), F.coalesce(col(text_col), F.lit("")))})
    light = marked.select(F.col(source).alias("source"), F.col(size).alias("size"), F.col(h).alias("hash"))
    classes = checkpoint(light.groupBy("source", "size", "hash").agg(F.count("*").alias("c")))
    cells = checkpoint(classes.groupBy("source", "size").agg(F.sum("c").alias("n")))
    goals = targets(cells).withColumnRenamed("source", "goal_source")
    plan = checkpoint(thresholds(classes, copies_by_cell(cells, solve(cells, goals))))
    tied = not plan.where("odd < alike").isEmpty()
    renamed = {"source": s, "size": z, "source_size": source_size, "target": target, "each": each, "cut": cut, "odd": odd, "alike": alike}
    plan = plan.select(*[F.col(k).alias(v) for k, v in renamed.items()])
    if cells.count() <= BROADCAST_CELLS:
        plan = F.broadcast(plan)
    rows = marked.join(plan, F.col(source).eqNullSafe(F.col(s)) & (F.col(size) == F.col(z))).drop(s, z)
    extra = F.coalesce((F.col(h) < F.col(cut)).cast("long"), F.lit(0))
    some = F.coalesce((F.col(h) == F.col(cut)) & (F.col(odd) < F.col(alike)), F.lit(False))
    whole = rows.where(~some) if tied else rows
    whole = whole.withColumn(copies, F.col(each) + extra + F.coalesce((F.col(h) == F.col(cut)).cast("long"), F.lit(0)))
    if tied:  # rows of one id and text of which some get one more copy
        few = numbered(rows.where(some), [source, size, h], own[12:])
        whole = whole.unionByName(few.withColumn(copies, F.col(each) + (F.col(number) <= F.col(odd)).cast("long")).drop(number))
    return whole.withColumn(copies, F.when(F.col(size) == 0, 1).otherwise(F.col(copies)).cast("long")), {"size": size, "source_size": source_size, "target": target, "copies": copies}


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Every row of docs with size, source_size, target, copies and taken (copies times size), in place of columns so named."""
    rows, made = planned(docs, id_col, source_col, text_col)
    given = [col(c) for c in docs.columns if c.lower() not in (*made, "taken")]
    return rows.select(*given, *[F.col(v).alias(k) for k, v in made.items()], (F.col(made["copies"]) * F.col(made["size"])).alias("taken"))


def repeat(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Every row of docs as often as the mix takes it."""
    rows, made = planned(docs, id_col, source_col, text_col)
    (turn,) = fresh(rows.columns, "turn")
    rows = rows.withColumn(turn, F.explode(F.array_repeat(F.lit(1), F.col(made["copies"]).cast("int"))))
    return rows.select(*[col(c) for c in docs.columns])
