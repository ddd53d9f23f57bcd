"""Row-level validation that a schema change asks for: keys, nulls, checks, casts, labels, partition bounds.

Every validator is one pass: a filter, an anti join or an aggregate with a partial stage before its shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalpa.session import table

#: The natural foreign keys of the tables: name, child, its key, parent, its key.
FOREIGN_KEYS = (
    ("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("labels_document", "labels", "doc_id", "documents", "doc_id"),
    ("lineitem_order", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("nation_region", "nation", "n_regionkey", "region", "r_regionkey"),
    ("orders_customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("supplier_nation", "supplier", "s_nationkey", "nation", "n_nationkey"),
)


def foreign_key_orphans(child: DataFrame, parent: DataFrame, fk: list[str], pk: list[str]) -> DataFrame:
    """Child rows whose key is wholly non-null and has no parent row."""
    keyed = child.where(" AND ".join(f"`{c}` IS NOT NULL" for c in fk))
    on = [child[f] == parent[p] for f, p in zip(fk, pk, strict=True)]
    return keyed.join(parent.select(*pk), on, "left_anti")


def foreign_key_report(name: str, child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """One row: rows checked, rows with a null key, orphans. The child is grouped by key before it meets the parent."""
    keys = child.groupBy(F.col(fk).alias("k")).agg(F.count("*").alias("n"))
    known = parent.select(F.col(pk).alias("p")).distinct()
    joined = keys.join(known, F.col("k") == F.col("p"), "left")
    orphan = F.col("k").isNotNull() & F.col("p").isNull()
    return joined.agg(
        F.lit(name).alias("constraint_name"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_checked"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("orphans"),
    )


def foreign_key_reports(constraints: list[tuple[str, DataFrame, list[tuple[str, str, DataFrame, str]]]]) -> DataFrame:
    """foreign_key_report of many constraints, (child's name, child, [(name, fk, parent, pk)]): each child is read once, and one join serves all.

    Keys are compared as longs. A key that holds many rows is counted before it is shuffled.
    """
    sides, parents, names = [], [], []
    for _, child, own in constraints:
        each = F.explode(F.array(*[F.struct(F.lit(name).alias("constraint_name"), F.col(fk).cast("long").alias("k")) for name, fk, _, _ in own]))
        sides.append(child.select(each.alias("x")).select("x.*"))
        parents += [parent.select(F.lit(name).alias("constraint_name"), F.col(pk).cast("long").alias("k")) for name, _, parent, pk in own]
        names += [(name,) for name, _, _, _ in own]
    counted = reduce(DataFrame.unionByName, sides).groupBy("constraint_name", "k").agg(F.count("*").alias("n"))
    known = reduce(DataFrame.unionByName, parents).distinct().withColumn("has", F.lit(True))
    met = counted.join(known, ["constraint_name", "k"], "left")
    sums = met.groupBy("constraint_name").agg(F.sum("n").alias("rows_checked"), F.sum(F.when(F.col("k").isNull(), F.col("n"))).alias("null_keys"), F.sum(F.when(F.col("k").isNotNull() & F.col("has").isNull(), F.col("n"))).alias("orphans"))
    every = sums.sparkSession.createDataFrame(names, "constraint_name string")
    return every.join(sums, "constraint_name", "left").select("constraint_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_checked", "null_keys", "orphans")])


def check_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule: how many rows fail, from one pass; a check that is null passes, as in SQL."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(~passes).alias(f"v{i}") for i, passes in enumerate(rules.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("constraint_name"), F.col("n").alias("rows_checked"), F.col(f"v{i}").alias("violations")) for i, name in enumerate(rules)])
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def not_null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column with its nulls, from one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])).alias("x")).select("x.*")


def cast_failures(df: DataFrame, column: str, to: str) -> DataFrame:
    """Rows whose value can't become the new type."""
    return df.where(F.col(column).isNotNull() & F.col(column).try_cast(to).isNull())


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand in more than one row, with their counts."""
    return df.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


def label_violations(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Non-null values outside the labels, counted."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(labels)).groupBy(F.col(column).alias("label")).agg(F.count("*").alias("rows"))


def route_range(column: str, bounds: list[tuple[str, object, object]]) -> Column:
    """Name of the partition whose [low, high) holds the value; null low or high is open; null where none does."""
    routed = F.lit(None).cast("string")
    for name, low, high in reversed(bounds):
        inside = F.col(column).isNotNull()
        if low is not None:
            inside &= F.col(column) >= F.lit(low)
        if high is not None:
            inside &= F.col(column) < F.lit(high)
        routed = F.when(inside, F.lit(name)).otherwise(routed)
    return routed


def route_list(column: str, lists: dict[str, list], default: str | None = None) -> Column:
    """Name of the partition that lists the value, else the default partition."""
    routed = F.lit(default).cast("string")
    for name, values in reversed(list(lists.items())):
        routed = F.when(F.col(column).isin(values), F.lit(name)).otherwise(routed)
    return routed


def outside_bounds(df: DataFrame, route: Column, partition: str) -> DataFrame:
    """Rows that an attached partition would have to refuse."""
    return df.where(~route.eqNullSafe(F.lit(partition)))


def fk_summary(spark, sf_dir: str) -> DataFrame:
    children: dict[str, list] = {}
    for name, child, fk, parent, pk in FOREIGN_KEYS:
        children.setdefault(child, []).append((name, fk, table(spark, sf_dir, parent), pk))
    return foreign_key_reports([(child, table(spark, sf_dir, child), own) for child, own in children.items()])


def fk_orphans(spark, sf_dir: str) -> DataFrame:
    """Orders left without a customer once a market segment is taken out, by priority."""
    parent = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    lost = foreign_key_orphans(table(spark, sf_dir, "orders"), parent, ["o_custkey"], ["c_custkey"])
    return lost.groupBy("o_orderpriority").agg(F.count("*").alias("orphans"), F.min("o_orderkey").alias("first_orderkey"))


def fk_orphans_dirty(spark, sf_dir: str) -> DataFrame:
    """Line items of orders that a filter has taken away, counted by order."""
    parent = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    lost = foreign_key_orphans(table(spark, sf_dir, "lineitem"), parent, ["l_orderkey"], ["o_orderkey"])
    return lost.groupBy("l_orderkey").agg(F.count("*").alias("orphans"))


CHECKS = (
    ("quantity_range", "lineitem", "l_quantity >= 1 AND l_quantity <= 50"),
    ("discount_low", "lineitem", "l_discount < 0.05"),
    ("price_positive", "orders", "o_totalprice > 0"),
    ("late_order", "orders", "o_orderdate < timestamp '1995-06-17 00:00:00'"),
    ("size_even", "part", "p_size % 2 = 0"),
)


def checks(spark, sf_dir: str) -> DataFrame:
    by_table: dict[str, dict[str, Column]] = {}
    for name, t, rule in CHECKS:
        by_table.setdefault(t, {})[name] = F.expr(rule)
    return reduce(DataFrame.unionByName, [check_violations(table(spark, sf_dir, t), rules) for t, rules in by_table.items()])


def not_null_scan(spark, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("rating", F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END"))
    return not_null_report(events, ["event_id", "ts", "user_id", "event_type", "value", "props", "rating"])


def type_change_failures(spark, sf_dir: str) -> DataFrame:
    """Events whose number in props, or whose type, couldn't become a number; the three columns tried in one pass."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.regexp_extract("props", r"(\d+)", 1).alias("k"), F.concat(F.col("user_id").cast("string"), F.when(F.col("event_id") % 5 == 0, "x").otherwise("")).alias("u"))
    tries = [("k", "smallint"), ("u", "bigint"), ("event_type", "int")]
    parts = [cast_failures(events, c, to).groupBy(F.lit(c).alias("column_name"), F.lit(to).alias("new_type")).agg(F.count("*").alias("failures"), F.min("event_id").alias("first_event")) for c, to in tries]
    return reduce(DataFrame.unionByName, parts)


def pk_duplicates(spark, sf_dir: str) -> DataFrame:
    return duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def enum_violations(spark, sf_dir: str) -> DataFrame:
    return label_violations(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"])


def partition_route(spark, sf_dir: str) -> DataFrame:
    """Orders by half-open date range, status list and key modulo, with rows that no range or list takes."""
    by_date = [("before_1994", None, "1994-01-01"), ("y1994", "1994-01-01", "1995-01-01"), ("y1995", "1995-01-01", "1996-01-01")]
    bounds = [(n, None if a is None else F.to_timestamp(F.lit(a)), None if b is None else F.to_timestamp(F.lit(b))) for n, a, b in by_date]
    orders = table(spark, sf_dir, "orders")
    routed = orders.select(route_range("o_orderdate", bounds).alias("by_range"), route_list("o_orderstatus", {"closed": ["F"], "open": ["O"]}, "other").alias("by_list"), (F.col("o_orderkey") % 4).alias("by_hash"))
    return routed.groupBy("by_range", "by_list", "by_hash").agg(F.count("*").alias("rows"))


def attach_scan(spark, sf_dir: str) -> DataFrame:
    """Returned line items that a partition for the flags A and N would refuse."""
    items = table(spark, sf_dir, "lineitem")
    refused = outside_bounds(items, route_list("l_returnflag", {"kept": ["A", "N"]}), "kept")
    return refused.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("refused"))


QUERIES = {f.__name__: f for f in (fk_summary, fk_orphans, fk_orphans_dirty, not_null_scan, type_change_failures, pk_duplicates, enum_violations, partition_route, attach_scan)}
QUERIES["check_violations"] = checks

ORACLES = {
    "fk_summary": " UNION ALL ".join(
        f"SELECT '{name}' AS constraint_name, count(*) AS rows_checked, count(*) - count({fk}) AS null_keys, "
        f"count(*) FILTER (WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {parent})) AS orphans FROM {child}"
        for name, child, fk, parent, pk in FOREIGN_KEYS
    ),
    "fk_orphans": """
        SELECT o_orderpriority, count(*) AS orphans, min(o_orderkey) AS first_orderkey
        FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING')
        GROUP BY o_orderpriority""",
    "fk_orphans_dirty": """
        SELECT l_orderkey, count(*) AS orphans FROM lineitem
        WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')
        GROUP BY l_orderkey""",
    "check_violations": " UNION ALL ".join(
        f"SELECT '{name}' AS constraint_name, count(*) AS rows_checked, count(*) FILTER (WHERE NOT ({rule})) AS violations FROM {t}" for name, t, rule in CHECKS
    ),
    "not_null_scan": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {'CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END' if c == 'rating' else c} IS NULL) AS nulls FROM events"
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props", "rating")
    ),
    "type_change_failures": """
        WITH e AS (
            SELECT event_id, event_type, regexp_extract(props, '(\\d+)', 1) AS k,
                   CAST(user_id AS VARCHAR) || CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '' END AS u FROM events)
        SELECT 'k' AS column_name, 'smallint' AS new_type, count(*) AS failures, min(event_id) AS first_event FROM e WHERE k IS NOT NULL AND TRY_CAST(k AS SMALLINT) IS NULL HAVING count(*) > 0
        UNION ALL SELECT 'u', 'bigint', count(*), min(event_id) FROM e WHERE u IS NOT NULL AND TRY_CAST(u AS BIGINT) IS NULL HAVING count(*) > 0
        UNION ALL SELECT 'event_type', 'int', count(*), min(event_id) FROM e WHERE event_type IS NOT NULL AND TRY_CAST(event_type AS INTEGER) IS NULL HAVING count(*) > 0""",
    "pk_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "enum_violations": "SELECT o_orderstatus AS label, count(*) AS rows FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY o_orderstatus",
    "partition_route": """
        SELECT CASE WHEN o_orderdate < TIMESTAMP '1994-01-01' THEN 'before_1994' WHEN o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1995-01-01' THEN 'y1994'
                    WHEN o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'y1995' END AS by_range,
               CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS by_list,
               o_orderkey % 4 AS by_hash, count(*) AS rows
        FROM orders GROUP BY ALL""",
    "attach_scan": "SELECT l_returnflag, l_linestatus, count(*) AS refused FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') OR l_returnflag IS NULL GROUP BY ALL",
}
