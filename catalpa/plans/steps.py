"""Steps of plans: order, transaction groups, hazards, drop policy, summary, locks, dependency closure.

Any number of plans is handled at once; steps carry their plan's key. Maps of change types are literals, so most operators are
projections; only order and groups need a window, by plan.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalpa.functions import sqltypes
from catalpa.operators.ledger import step_groups
from catalpa.plans import generated, samples, vocabulary
from catalpa.session import checkpoint


def mapped(change_type: Column, pairs: dict, default=None) -> Column:
    found = sqltypes.lookup(change_type, pairs)
    return found if default is None else F.coalesce(found, F.lit(default))


def in_phases(steps: DataFrame, plan: str = "plan_id") -> DataFrame:
    """steps with place in their plan: by priority of the change type (0 for a type without one), schema, table and text; input order breaks ties."""
    keyed = steps.withColumn("priority", mapped(F.col("change_type"), vocabulary.PRIORITY, 0))
    w = Window.partitionBy(plan).orderBy("priority", *(["sch"] if "sch" in steps.columns else []), "tbl", "sql_text", "idx")
    return keyed.withColumn("place", F.row_number().over(w))


def by_need(keys: list[str], needs: dict[str, set[str]]) -> list[str]:
    """keys so that what is needed comes first, the least name first among those ready; names on a cycle, or behind one, last."""
    left = {k: {n for n in needs.get(k, ()) if n in needs and n != k} for k in keys}
    behind: dict[str, list[str]] = {k: [] for k in keys}
    for k, own in left.items():
        for n in own:
            behind[n].append(k)
    ready, out = sorted(k for k, own in left.items() if not own), []
    while ready:
        k = heapq.heappop(ready)
        out.append(k)
        for b in behind[k]:
            left[b].discard(k)
            if not left[b]:
                heapq.heappush(ready, b)
    return out + sorted(set(keys) - set(out))


def ordered_by_need(objects: DataFrame, plan: str = "plan_id") -> DataFrame:
    """(plan, change_type, name, place) of created and dropped tables and views (name, needs), by their dependencies.

    objects has a row for each (name, needs), needs is null or empty where there is none; what isn't in the same phase doesn't count. The names of one phase of one plan meet
    in a task, as only the whole of them has an order; plans and phases are spread.
    """

    def arranged(change_type: str, rows: list[tuple[str, str | None]]) -> list[str]:
        names = {name for name, _ in rows}
        needs: dict[str, set[str]] = {n: set() for n in names}
        for name, need in rows:
            if need in names and need != name:
                first, second = (need, name) if vocabulary.ORDERED_BY_NEED[change_type] else (name, need)
                needs[first].add(second)
        return by_need(sorted(names), needs)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phases follow one another in a task's rows; one is arranged when the next begins."""
        key, held, kinds = None, [], None
        for batch in batches:
            kinds, done = kinds or [f.type for f in batch.schema], []
            for plan_id, change_type, name, need in zip(*[c.to_pylist() for c in batch.columns]):
                if held and key != (plan_id, change_type):
                    done.append((*key, arranged(key[1], held)))
                    held = []
                key = (plan_id, change_type)
                held.append((name, need))
            yield told(done, kinds)
        if held:
            yield told([(*key, arranged(key[1], held))], kinds)

    def told(done: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        rows = [(p, t, name, place) for p, t, names in done for place, name in enumerate(names, 1)]
        columns = [pa.array([r[i] for r in rows], type=kind) for i, kind in enumerate([*kinds[:3], pa.int32()])]
        return pa.RecordBatch.from_arrays(columns, names=[plan, "change_type", "name", "place"])

    kept = objects.where(F.col("change_type").isin(*vocabulary.ORDERED_BY_NEED)).select(plan, "change_type", "name", "needs")
    kind = dict(objects.dtypes)[plan]
    return kept.repartition(plan, "change_type").sortWithinPartitions(plan, "change_type").mapInArrow(each, f"{plan} {kind}, change_type string, name string, place int")


#: Hazards that a step's text or flags bring, beside those of its type: (code, level, condition).
HAZARDS = (
    ("UNMANAGED_DEPENDENCY", "CRITICAL", "unmanaged"),
    ("GENERATED_REWRITE", "CRITICAL", "generated"),
    (None, None, None),  # the type's own hazard stands here
    ("PARTITION_PENDING_DETACH", "WARNING", "change_type = 'DETACH_PARTITION' AND pending"),
    ("RENAME_AMBIGUOUS", "CRITICAL", "change_type = 'DROP_COLUMN' AND candidate"),
    ("TYPE_NARROW", "CRITICAL", "change_type = 'ALTER_COLUMN' AND narrowed"),
    ("ALTER_COLUMN", "NOTICE", "change_type = 'ALTER_COLUMN' AND NOT narrowed AND NOT generated"),
    ("NOT_NULL_NO_DEFAULT", "CRITICAL", "change_type = 'ADD_COLUMN' AND not_null AND dflt = ''"),
    ("CHECK_VALIDATE_SCAN", "NOTICE", "change_type = 'VALIDATE_CONSTRAINT' AND validates_check"),
    ("SECURITY_DEFINER", "WARNING", "change_type IN ('CREATE_FUNCTION', 'CREATE_AGGREGATE') AND contains(upper(sql_text), 'SECURITY DEFINER') AND NOT contains(lower(sql_text), 'search_path')"),
    ("DROP_COMPOSITE_TYPE", "CRITICAL", "change_type = 'ALTER_COMPOSITE_TYPE' AND destructive"),
    ("COMMENT_CLEAR", "NOTICE", "change_type IN ('COMMENT_TABLE', 'COMMENT_COLUMN') AND old_comment <> ''"),
    ("GRANT_PUBLIC", "WARNING", "change_type = 'GRANT' AND (upper(tbl) = 'PUBLIC' OR contains(upper(sql_text), 'TO PUBLIC'))"),
    ("PASSWORD_CHANGE", "WARNING", "change_type IN ('CREATE_ROLE', 'ALTER_ROLE') AND contains(upper(sql_text), 'PASSWORD')"),
    ("DROP_PUBLICATION", "CRITICAL", "change_type = 'ALTER_PUBLICATION' AND destructive"),
    ("PUBLICATION_ALL_TABLES", "NOTICE", "change_type IN ('CREATE_PUBLICATION', 'ALTER_PUBLICATION') AND (contains(upper(sql_text), 'SET ALL TABLES') OR contains(upper(sql_text), 'FOR ALL TABLES'))"),
)
#: What a step that doesn't say is taken to be.
UNSAID = {"pending": "false", "validates_check": "false", "old_comment": "''"}


def hazards(steps: DataFrame) -> DataFrame:
    """(plan_id if steps have it, idx, change_type, tbl, seq, code, level), in the order in which a step's hazards are told."""
    kind = F.col("change_type")
    by_type = F.when(kind.isin(*vocabulary.HAZARD_OF_TYPE), F.struct(mapped(kind, {k: c for k, (c, _) in vocabulary.HAZARD_OF_TYPE.items()}).alias("code"), mapped(kind, {k: v for k, (_, v) in vocabulary.HAZARD_OF_TYPE.items()}).alias("level")))
    found = F.array(*[F.when(F.expr(cond), F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"))) if code else by_type for code, level, cond in HAZARDS])
    full = steps.withColumns({c: F.expr(value) for c, value in UNSAID.items() if c not in steps.columns})
    key = [c for c in ("plan_id", "idx", "change_type", "tbl") if c in steps.columns]
    rows = full.select(*key, F.posexplode(F.filter(found, lambda h: h.isNotNull())).alias("seq", "h"))
    return rows.select(*key, "seq", "h.code", "h.level")


def with_remedies(found: DataFrame) -> DataFrame:
    """Hazards with a line on what can be done, where there is one."""
    return found.withColumn("remedy", mapped(F.col("code"), vocabulary.REMEDIES, ""))


def is_reversible() -> Column:
    return F.col("change_type").isin(*vocabulary.REVERSIBLE)


def is_outside_transactions() -> Column:
    """Whether a step can't run in a transaction; a detach with a partition left for all other rows can, as it isn't concurrent."""
    return F.col("change_type").isin(*vocabulary.OUTSIDE_TRANSACTIONS)


def drift(wanted: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """(key, steps, drifted) of every wanted key: the changes it needs, and whether there are any; a null in a key equals another."""
    steps = changes.groupBy(*[F.col(k).alias(f"{k}_") for k in key]).agg(F.count("*").alias("n"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in key])
    return wanted.select(*key).distinct().join(steps, same, "left").select(*key, F.coalesce("n", F.lit(0).cast("long")).alias("steps"), F.col("n").isNotNull().alias("drifted"))


def unexpected_plans(plans: DataFrame, expected: DataFrame) -> DataFrame:
    """Plans (plan_id, hash) whose hash isn't the expected one."""
    return plans.join(expected.withColumnRenamed("hash", "wanted"), "plan_id").where(~F.col("hash").eqNullSafe(F.col("wanted"))).select("plan_id", "hash", "wanted")


#: Fixed value: the longest time that a plan may ask a lock or statement to wait, a day in nanoseconds.
LONGEST_WAIT = 24 * 60 * 60 * 10**9


def refused_waits(plans: DataFrame) -> DataFrame:
    """Plans (plan_id, lock_wait, statement_wait in nanoseconds) that ask for a wait below nothing or beyond a day."""
    return plans.where(~F.col("lock_wait").between(0, LONGEST_WAIT) | ~F.col("statement_wait").between(0, LONGEST_WAIT))


def unaccepted(found: DataFrame, accepted: tuple[str, ...]) -> DataFrame:
    """Critical hazards that nobody has accepted."""
    return found.where((F.col("level") == "CRITICAL") & ~F.col("code").isin(*accepted))


def is_allowed(flags: tuple[str, ...]) -> Column:
    """Whether the drop policy lets a step pass; only destructive steps need a flag."""
    kind = F.col("change_type")
    open_types = [t for t, any_of in vocabulary.ALLOWED_BY.items() if set(any_of) & set(flags)]
    rebuilt = F.col("rebuild") & kind.isin(*vocabulary.REBUILT_WITH_FUNCTIONS) & F.lit("function" in flags)
    return ~F.col("destructive") | kind.isin(*open_types) | rebuilt


def summary(steps: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    """(plan_id if steps have it, additions, modifications, deletions, blocked, destructive)."""
    bucket = mapped(F.col("change_type"), {t: b for t in vocabulary.CHANGE_TYPES if (b := vocabulary.bucket(t))})
    count = lambda cond: F.count_if(cond)
    plan = ["plan_id"] if "plan_id" in steps.columns else []
    return steps.groupBy(*plan).agg(count(bucket == "addition").alias("additions"), count(bucket == "modification").alias("modifications"), count(bucket == "deletion").alias("deletions"), count(~is_allowed(flags)).alias("blocked"), F.coalesce(F.bool_or("destructive"), F.lit(False)).alias("destructive"))


def strong_locks(steps: DataFrame) -> DataFrame:
    """Tables that a step would lock against others, and the parents of partitions among them."""
    kind = F.col("change_type")
    needs = (F.col("tbl") != "") & (kind.isin(*vocabulary.STRONG_LOCK) | ((kind == "CREATE_INDEX") & ~F.col("non_tx")))
    plan = ["plan_id"] if "plan_id" in steps.columns else []
    locked = steps.where(needs)
    if "parent" in steps.columns:
        locked = locked.select(*plan, F.explode(F.array_distinct(F.array("tbl", "parent"))).alias("tbl")).where("tbl <> ''")
    return locked.select(*plan, "tbl").distinct()


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """(node, needs, depth): all that a node needs, over least depth; cycles end, as a pair once found isn't followed again.

    Distances double each turn (pairs are joined with pairs), so a chain of n links takes log2(n) turns.
    """
    reach = checkpoint(edges.select("node", "needs").distinct().withColumn("depth", F.lit(1)))
    size = reach.count()
    for _ in range(most):
        onward = reach.select(F.col("node").alias("needs"), F.col("needs").alias("far"), F.col("depth").alias("more"))
        longer = reach.join(onward, "needs").select("node", F.col("far").alias("needs"), (F.col("depth") + F.col("more")).alias("depth"))
        grown = checkpoint(reach.unionByName(longer).groupBy("node", "needs").agg(F.min("depth").alias("depth")))
        now = grown.agg(F.count("*"), F.sum("depth")).first()
        if now == size:
            break
        reach, size = grown, now
    return reach


def with_validation(steps: DataFrame) -> DataFrame:
    """Each added key or check is followed by a step that validates it."""
    adds = F.col("change_type").isin("ADD_FK", "ADD_CHECK")
    kinds = F.when(adds, F.array(F.col("change_type"), F.lit("VALIDATE_CONSTRAINT"))).otherwise(F.array("change_type"))
    return steps.select(*[c for c in steps.columns if c != "change_type"], F.posexplode(kinds).alias("part", "change_type"))


def frame(spark, sf_dir):
    return generated.frame(spark, sf_dir, "steps")


FLAGS = ("column", "function")


def plan_order(spark, sf_dir):
    return in_phases(frame(spark, sf_dir)).select("plan_id", "idx", "change_type", "priority", "place")


def plan_need_order(spark, sf_dir):
    tables = generated.frame(spark, sf_dir, "tables_needing")
    return ordered_by_need(tables.select("plan_id", "change_type", F.concat_ws(".", "sch", "tbl").alias("name"), "needs"))


def plan_groups(spark, sf_dir):
    return step_groups(frame(spark, sf_dir)).select("plan_id", "idx", "change_type", F.col("grp").cast("int").alias("grp"))


def plan_hazards(spark, sf_dir):
    return with_remedies(hazards(frame(spark, sf_dir)))


def plan_unaccepted(spark, sf_dir):
    return unaccepted(hazards(frame(spark, sf_dir)), ("DROP_TABLE", "TYPE_NARROW")).select("plan_id", "idx", "code")


def plan_blocked(spark, sf_dir):
    return frame(spark, sf_dir).where(~is_allowed(FLAGS)).select("plan_id", "idx", "change_type")


def plan_summary(spark, sf_dir):
    return summary(frame(spark, sf_dir), FLAGS)


def plan_locks(spark, sf_dir):
    return strong_locks(frame(spark, sf_dir))


def plan_validation(spark, sf_dir):
    return with_validation(frame(spark, sf_dir)).groupBy("plan_id", "change_type", "part").agg(F.count("*").alias("steps"))


def plan_reversible(spark, sf_dir):
    return frame(spark, sf_dir).groupBy("change_type").agg(F.bool_and(is_reversible()).alias("reversible"), F.bool_and(is_outside_transactions()).alias("non_tx"))


def plan_drift(spark, sf_dir):
    from catalpa.plans.changes import diff_columns

    with generated.kept_lines(spark, sf_dir) as lines:
        tables = checkpoint(generated.frame(spark, sf_dir, "desired_columns", lines).select("sch", "tbl").distinct())
        return drift(tables, diff_columns(spark, sf_dir, lines), ["sch", "tbl"])


def plan_hash_mismatch(spark, sf_dir):
    steps = frame(spark, sf_dir)
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sql_text"))), lambda s: s["sql_text"]), "\n"), 256)
    hashes = steps.groupBy("plan_id").agg(digest.alias("hash"))
    expected = hashes.withColumn("hash", F.when(F.col("plan_id") % 3 == 0, F.md5("hash")).otherwise(F.col("hash")))
    return unexpected_plans(hashes, expected)


def plan_waits(spark, sf_dir):
    plans = frame(spark, sf_dir).groupBy("plan_id").agg(((F.min("idx") - 5) * 10**9).alias("lock_wait"), (F.max("idx") * 10**10).alias("statement_wait"))
    return refused_waits(plans).select("plan_id")


def dep_closure(spark, sf_dir):
    """All that the tables of the sample and the plans' tables need."""
    tables = generated.frame(spark, sf_dir, "tables_needing").where("needs <> ''").select(F.concat_ws(".", "sch", "tbl").alias("node"), "needs")
    return closure(samples.EDGES.frame(spark).unionByName(tables))


QUERIES = {f.__name__: f for f in (plan_order, plan_need_order, plan_groups, plan_hazards, plan_unaccepted, plan_blocked, plan_summary, plan_locks, plan_validation, plan_reversible, plan_drift, plan_hash_mismatch, plan_waits, dep_closure)}


def pairs(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(samples.literal(v, "string") for v in r) + ")" for r in rows) + ")"


def changes_sql(tail: str) -> str:
    """The twin of diff_columns as the relation c, with a further SELECT over it."""
    from catalpa.plans.changes import ORACLES as changes

    return "WITH c AS (" + changes["diff_columns"] + ") " + tail


PRIORITIES = pairs("p", "t, priority", vocabulary.PRIORITY.items())
HAZARD_TYPES = pairs("ht", "t, code, level", [(t, *x) for t, x in vocabulary.HAZARD_OF_TYPE.items()])
UPPER = "upper(sql_text)"
HAZARD_SQL = f""", {HAZARD_TYPES}, h AS (
    SELECT *, 1 AS o, 'UNMANAGED_DEPENDENCY' AS code, 'CRITICAL' AS level FROM s WHERE unmanaged
    UNION ALL SELECT *, 2, 'GENERATED_REWRITE', 'CRITICAL' FROM s WHERE generated
    UNION ALL SELECT s.*, 3, ht.code, ht.level FROM s JOIN ht ON t = change_type
    UNION ALL SELECT *, 4, 'PARTITION_PENDING_DETACH', 'WARNING' FROM s WHERE change_type = 'DETACH_PARTITION' AND pending
    UNION ALL SELECT *, 4, 'RENAME_AMBIGUOUS', 'CRITICAL' FROM s WHERE change_type = 'DROP_COLUMN' AND candidate
    UNION ALL SELECT *, 4, CASE WHEN narrowed THEN 'TYPE_NARROW' ELSE 'ALTER_COLUMN' END, CASE WHEN narrowed THEN 'CRITICAL' ELSE 'NOTICE' END FROM s WHERE change_type = 'ALTER_COLUMN' AND (narrowed OR NOT generated)
    UNION ALL SELECT *, 4, 'NOT_NULL_NO_DEFAULT', 'CRITICAL' FROM s WHERE change_type = 'ADD_COLUMN' AND not_null AND dflt = ''
    UNION ALL SELECT *, 4, 'CHECK_VALIDATE_SCAN', 'NOTICE' FROM s WHERE change_type = 'VALIDATE_CONSTRAINT' AND validates_check
    UNION ALL SELECT *, 4, 'SECURITY_DEFINER', 'WARNING' FROM s WHERE change_type IN ('CREATE_AGGREGATE', 'CREATE_FUNCTION') AND {UPPER} LIKE '%SECURITY DEFINER%' AND NOT contains({UPPER}, 'SEARCH_PATH')
    UNION ALL SELECT *, 4, CASE change_type WHEN 'ALTER_PUBLICATION' THEN 'DROP_PUBLICATION' ELSE 'DROP_COMPOSITE_TYPE' END, 'CRITICAL' FROM s WHERE destructive AND change_type IN ('ALTER_PUBLICATION', 'ALTER_COMPOSITE_TYPE')
    UNION ALL SELECT *, 4, 'COMMENT_CLEAR', 'NOTICE' FROM s WHERE starts_with(change_type, 'COMMENT_') AND old_comment <> ''
    UNION ALL SELECT *, 4, 'GRANT_PUBLIC', 'WARNING' FROM s WHERE change_type = 'GRANT' AND {UPPER} LIKE '%TO PUBLIC%'
    UNION ALL SELECT *, 4, 'PASSWORD_CHANGE', 'WARNING' FROM s WHERE change_type IN ('ALTER_ROLE', 'CREATE_ROLE') AND {UPPER} LIKE '%PASSWORD%'
    UNION ALL SELECT *, 5, 'PUBLICATION_ALL_TABLES', 'NOTICE' FROM s WHERE change_type IN ('ALTER_PUBLICATION', 'CREATE_PUBLICATION') AND ({UPPER} LIKE '%SET ALL TABLES%' OR {UPPER} LIKE '%FOR ALL TABLES%')) """
REMEDY_SQL = "CASE code " + " ".join(f"WHEN '{code}' THEN {samples.literal(line, 'string')}" for code, line in vocabulary.REMEDIES.items()) + " ELSE '' END"
ALLOWED_SQL = "change_type NOT IN ('ALTER_COLUMN', 'DROP_COLUMN', 'DROP_FUNCTION', 'DROP_AGGREGATE') AND NOT (rebuild AND change_type IN ('DROP_TRIGGER', 'DROP_VIEW'))"
twin = generated.twin
ORACLES = {
    "plan_order": twin(f", {PRIORITIES} SELECT plan_id, idx, change_type, CAST(coalesce(priority, 0) AS INTEGER) AS priority, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY coalesce(priority, 0), sch, tbl, sql_text, idx) AS INTEGER) AS place FROM s LEFT JOIN p ON t = change_type", s="steps"),
    "plan_need_order": twin(
        """/* recursive */, n AS (SELECT DISTINCT plan_id, change_type, sch || '.' || tbl AS name FROM x),
        e AS (SELECT DISTINCT x.plan_id, x.change_type, CASE x.change_type WHEN 'CREATE_TABLE' THEN n.name ELSE sch || '.' || tbl END AS before, CASE x.change_type WHEN 'CREATE_TABLE' THEN sch || '.' || tbl ELSE n.name END AS after
            FROM x JOIN n ON n.plan_id = x.plan_id AND n.change_type = x.change_type AND n.name = x.needs AND n.name <> sch || '.' || tbl),
        g AS (SELECT plan_id, change_type, list(name ORDER BY name) AS names FROM n GROUP BY ALL),
        ge AS (SELECT plan_id, change_type, list({'before': before, 'after': after}) AS links FROM e GROUP BY ALL),
        r AS (SELECT plan_id, change_type, names, coalesce(links, []) AS links, CAST([] AS VARCHAR[]) AS done, true AS going FROM g LEFT JOIN ge USING (plan_id, change_type)
            UNION ALL SELECT plan_id, change_type, names, links, CASE WHEN len(ready) > 0 THEN list_append(done, ready[1]) ELSE done END, len(ready) > 0
            FROM (SELECT *, list_filter(names, lambda n: NOT list_contains(done, n) AND len(list_filter(links, lambda l: l.after = n AND NOT list_contains(done, l.before))) = 0) AS ready FROM r WHERE going)),
        o AS (SELECT plan_id, change_type, done || list_filter(names, lambda n: NOT list_contains(done, n)) AS names FROM r WHERE NOT going)
        SELECT plan_id, change_type, unnest(names) AS name, CAST(unnest(range(1, len(names) + 1)) AS INTEGER) AS place FROM o""", x="tables_needing"),
    "plan_groups": twin(
        """, f AS (SELECT plan_id, idx, change_type, CASE WHEN lag(idx) OVER w IS NULL OR lag(non_tx) OVER w <> non_tx OR change_type = 'VALIDATE_CONSTRAINT' OR lag(change_type) OVER w = 'VALIDATE_CONSTRAINT' THEN 1 ELSE 0 END AS f FROM s WINDOW w AS (PARTITION BY plan_id ORDER BY idx))
        SELECT plan_id, idx, change_type, CAST(sum(f) OVER (PARTITION BY plan_id ORDER BY idx) AS INTEGER) AS grp FROM f""", s="steps"),
    "plan_hazards": twin(HAZARD_SQL + f"SELECT plan_id, idx, change_type, tbl, CAST(row_number() OVER (PARTITION BY plan_id, idx ORDER BY o) - 1 AS INTEGER) AS seq, code, level, {REMEDY_SQL} AS remedy FROM h", s="steps"),
    "plan_unaccepted": twin(HAZARD_SQL + "SELECT plan_id, idx, code FROM h WHERE level = 'CRITICAL' AND code NOT IN ('DROP_TABLE', 'TYPE_NARROW')", s="steps"),
    "plan_blocked": twin(f" SELECT plan_id, idx, change_type FROM s WHERE destructive AND {ALLOWED_SQL}", s="steps"),
    "plan_summary": twin(
        f""" SELECT plan_id, count(*) FILTER (WHERE regexp_matches(change_type, '^(CREATE|ADD)_') OR change_type IN ('ENABLE_RLS', 'FORCE_RLS', 'GRANT')) AS additions,
        count(*) FILTER (WHERE starts_with(change_type, 'ALTER_') OR change_type IN ('REFRESH_MATVIEW', 'DISABLE_RLS', 'NO_FORCE_RLS', 'REVOKE', 'RENAME_ENUM_VALUE')) AS modifications,
        count(*) FILTER (WHERE starts_with(change_type, 'DROP_') AND change_type NOT IN ('DROP_RANGE_RETYPE', 'DROP_COMPOSITE_RETYPE')) AS deletions,
        count(*) FILTER (WHERE destructive AND {ALLOWED_SQL}) AS blocked, bool_or(destructive) AS destructive FROM s GROUP BY plan_id""", s="steps"),
    "plan_locks": twin(
        """, w AS (SELECT * FROM s WHERE change_type = 'CREATE_INDEX' AND NOT non_tx OR change_type IN ('DROP_TABLE', 'ADD_COLUMN', 'DROP_COLUMN', 'ALTER_COLUMN', 'RENAME_COLUMN', 'ADD_FK', 'DROP_FK', 'ADD_CHECK', 'DROP_CHECK', 'VALIDATE_CONSTRAINT', 'ATTACH_PARTITION', 'DETACH_PARTITION',
            'ENABLE_RLS', 'DISABLE_RLS', 'FORCE_RLS', 'NO_FORCE_RLS', 'CREATE_POLICY', 'ALTER_POLICY', 'DROP_POLICY', 'CREATE_TRIGGER', 'DROP_TRIGGER', 'COMMENT_TABLE', 'COMMENT_COLUMN', 'DROP_INDEX'))
        SELECT plan_id, tbl FROM w UNION SELECT plan_id, parent FROM w WHERE parent <> ''""", s="steps"),
    "plan_validation": twin(" SELECT plan_id, change_type, CAST(part AS INTEGER) AS part, count(*) AS steps FROM (SELECT plan_id, change_type, 0 AS part FROM s UNION ALL SELECT plan_id, 'VALIDATE_CONSTRAINT', 1 FROM s WHERE change_type IN ('ADD_FK', 'ADD_CHECK')) GROUP BY ALL", s="steps"),
    "plan_reversible": twin(
        """ SELECT DISTINCT change_type, (regexp_matches(change_type, '^(CREATE|ADD)_') AND change_type NOT IN ('CREATE_COMPOSITE_TYPE', 'CREATE_ENUM', 'CREATE_EVENT_TRIGGER', 'CREATE_EXTENSION', 'CREATE_PUBLICATION', 'CREATE_RANGE_TYPE', 'CREATE_REPLICATION_SLOT', 'CREATE_SEQUENCE', 'CREATE_SUBSCRIPTION'))
            OR ends_with(change_type, '_RLS') OR change_type LIKE '%COMMENT%' OR change_type IN ('RENAME_COLUMN', 'ATTACH_PARTITION', 'REFRESH_MATVIEW', 'ALTER_DOMAIN', 'ALTER_ROLE', 'GRANT', 'REVOKE') AS reversible,
        change_type IN ('CREATE_INDEX', 'DROP_INDEX', 'ALTER_ENUM', 'CREATE_SUBSCRIPTION', 'DROP_SUBSCRIPTION') AS non_tx FROM s""", s="steps"),
    "plan_drift": changes_sql("SELECT w.sch, w.tbl, count(c.sch) AS steps, bool_or(c.sch IS NOT NULL) AS drifted FROM (SELECT DISTINCT sch, tbl FROM (" + generated.SQL["desired_columns"].replace("{lineitem}", "lineitem") + ")) w LEFT JOIN c ON c.sch = w.sch AND c.tbl = w.tbl GROUP BY w.sch, w.tbl"),
    "plan_hash_mismatch": twin(", h AS (SELECT plan_id, sha256(string_agg(sql_text, chr(10) ORDER BY idx)) AS hash FROM s GROUP BY plan_id) SELECT plan_id, hash, md5(hash) AS wanted FROM h WHERE plan_id % 3 = 0", s="steps"),
    "plan_waits": twin(" SELECT plan_id FROM s GROUP BY plan_id HAVING min(idx) < 5 OR max(idx) > 8640 OR (min(idx) - 5) > 86400", s="steps"),
    "dep_closure": "WITH RECURSIVE " + samples.EDGES.sql("sample") + ", " + twin("", x="tables_needing").removeprefix("WITH ") + """, e AS (SELECT node, needs FROM sample UNION SELECT sch || '.' || tbl, needs FROM x WHERE needs <> ''),
        r AS (SELECT node, needs, 1 AS depth FROM e UNION SELECT r.node, e.needs, r.depth + 1 FROM r JOIN e ON r.needs = e.node WHERE r.depth < 100)
        SELECT node, needs, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node, needs""",
}
