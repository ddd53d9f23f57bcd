"""Lint rules over a schema snapshot: each is a DataFrame of diagnostics (rule, severity, tbl, item).

A snapshot is a set of DataFrames: tables(tbl, comment, rls, partition, policies), columns(tbl, col, data_type, dflt, identity),
keys(tbl, cols), indexes(tbl, name, cols, is_unique, predicate), fks(tbl, name, cols, on_delete), checks(tbl, name, expr),
triggers(tbl, name, fn), routines(fn), enums(name), extensions(name, version). Rules join on the table, so one run lints any number of tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalpa.functions import sqltypes
from catalpa.plans import generated
from catalpa.session import checkpoint

Snapshot = dict[str, DataFrame]

#: What the rules look for.
KEY_TYPES = ("bigint", "int8", "bigserial", "integer", "int", "int4", "serial", "smallint", "int2", "smallserial", "uuid")
MONEY_WORDS = ("amount", "price", "balance", "cost", "total", "fee")
FLOAT_TYPES = ("FLOAT", "REAL", "FLOAT4", "FLOAT8", "DOUBLE PRECISION")
FLAG_NAMES = ("is_active", "is_deleted", "deleted", "enabled", "active")
TENANT_COLUMNS = ("tenant_id", "org_id", "organization_id", "account_id")
RESERVED = (
    "all", "alter", "and", "as", "asc", "check", "column", "constraint", "create", "database", "default", "delete", "desc", "distinct", "drop",
    "else", "foreign", "from", "group", "having", "in", "index", "insert", "into", "is", "join", "key", "limit", "not", "null", "on", "or",
    "order", "primary", "references", "select", "set", "table", "to", "union", "unique", "update", "user", "values", "where",
)


def told(df: DataFrame, rule: str, severity: str, item: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "tbl", item.alias("item"))


def not_snake(name: str):
    return lambda: ~sqltypes.is_snake_case(F.col(name))


def is_reserved(name: str):
    return lambda: F.lower(name).isin(*RESERVED)


def money_as_float() -> Column:
    kind = F.upper(F.trim("data_type"))
    return F.lower("col").rlike("|".join(MONEY_WORDS)) & (kind.isin(*FLOAT_TYPES) | kind.startswith("FLOAT("))


def is_boolean() -> Column:
    return F.lower(F.trim("data_type")).isin("boolean", "bool")


#: Rules that look at one row: (severity, [(kind of row, condition, item)]). All those of a kind are told in one pass over its rows.
ROW_RULES = {
    "L003": ("WARNING", [("tables", not_snake("tbl"), "tbl"), ("columns", not_snake("col"), "col"), ("indexes", not_snake("name"), "name"), ("enums", not_snake("name"), "name")]),
    "L004": ("WARNING", [("columns", lambda: ~F.col("identity") & (F.lower("data_type").contains("serial") | F.col("dflt").contains("nextval(")), "col")]),
    "L005": ("WARNING", [("checks", not_snake("name"), "name")]),
    "L008": ("WARNING", [("tables", lambda: F.expr("rls AND policies = 0"), None)]),
    "L016": ("INFO", [("tables", lambda: F.expr("NOT partition AND comment = ''"), None)]),
    "L022": ("ERROR", [("tables", is_reserved("tbl"), None), ("columns", is_reserved("col"), "col")]),
    "L032": ("ERROR", [("columns", money_as_float, "col")]),
    "L033": ("WARNING", [("fks", lambda: (F.upper("on_delete") == "CASCADE") & F.exists("cols", lambda c: F.lower(c).isin(*TENANT_COLUMNS)), "name")]),
    "L044": ("WARNING", [("columns", lambda: is_boolean() & (F.trim("dflt") == ""), "col")]),
    "L049": ("WARNING", [("indexes", lambda: F.size("cols") > 4, "name")]),
}


def row_diagnostics(s: Snapshot, rules: list[str]) -> list[DataFrame]:
    """What the row rules named say, a DataFrame for each kind of row of the snapshot."""
    by_kind: dict[str, list[Column]] = {}
    for rule in rules:
        severity, parts = ROW_RULES[rule]
        for kind, fires, item in parts:
            told_row = F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (F.col(item) if item else F.lit("")).alias("item"))
            by_kind.setdefault(kind, []).append(F.when(fires(), told_row))
    out = []
    for kind, tests in by_kind.items():
        if kind in s:
            tbl = F.col("tbl") if "tbl" in s[kind].columns else F.lit("").alias("tbl")
            out.append(s[kind].select(tbl, F.explode(F.array_compact(F.array(*tests))).alias("d")).select("d.rule", "d.severity", "tbl", "d.item"))
    return out


def by_row(s: Snapshot, rule: str) -> DataFrame:
    """What one row rule says of the kinds of rows that the snapshot has."""
    return reduce(DataFrame.unionByName, row_diagnostics(s, [rule]))


def float_money(s: Snapshot) -> DataFrame:
    return by_row(s, "L032")


def reserved(s: Snapshot) -> DataFrame:
    return by_row(s, "L022")


def no_key(s: Snapshot) -> DataFrame:
    return told(s["tables"].where("NOT partition").join(s["keys"], "tbl", "left_anti"), "L001", "ERROR", F.lit(""))


def leading(cols: Column) -> Column:
    """Of a key's columns the first one, the first two and so on, each sorted."""
    return F.transform(F.sequence(F.lit(1), F.size(cols)), lambda n: F.array_sort(F.slice(cols, 1, n)))


def unindexed_fk(s: Snapshot) -> DataFrame:
    """The leading columns of an index or key, in any order, cover a foreign key; they meet by equality, not pair by pair."""
    keys = s["indexes"].select("tbl", "cols").unionByName(s["keys"].select("tbl", "cols")).where(F.size("cols") > 0)
    leads = keys.select("tbl", F.explode(leading(F.col("cols"))).alias("lead"))
    fks = s["fks"].where(F.size("cols") > 0).withColumn("lead", F.array_sort("cols"))
    return told(fks.join(leads, ["tbl", "lead"], "left_anti"), "L002", "WARNING", F.col("name"))


def made_up_check(s: Snapshot) -> DataFrame:
    prefix = F.regexp_extract("name", r"^(.+)_check\d*$", 1)
    columns = s["columns"].select("tbl", F.concat_ws("_", "tbl", "col").alias("prefix")).unionByName(s["tables"].select("tbl", F.col("tbl").alias("prefix")))
    own = s["checks"].where(F.startswith("name", F.col("tbl"))).withColumn("prefix", prefix)  # the others have no column's name
    return told(own.join(columns, ["tbl", "prefix"], "left_semi"), "L007", "INFO", F.col("name"))


def given(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often then names it."""
    return F.transform(F.array(value), then)[0]


def folded_check(expr: Column) -> Column:
    """A check's expression without blanks and case outside quoted text, and without a word or nothing before parentheses that hold all of the rest."""
    pieces = F.transform(F.split(expr, "'"), lambda p, i: F.when(i % 2 == 0, F.regexp_replace(F.lower(p), r"[ \t\r\n]", "")).otherwise(p))

    def walk(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(acc["quoted"], 0).when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return given(depth, lambda d: F.struct(d.alias("depth"), (acc["quoted"] != (c == "'")).alias("quoted"), (acc["shut"] + (d == 0).cast("int")).alias("shut")))

    def unwrap(e: Column, _: Column) -> Column:
        begin = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("shut"))
        marks = lambda rest: F.split(F.regexp_replace(rest, "[^()']+", "x"), "")  # noqa: E731  # a run of other characters counts as one
        whole = lambda rest: F.aggregate(marks(rest), begin, walk)["shut"] == 1  # noqa: E731  # closed once, at its end
        rest = F.regexp_extract(e, r"(?s)^[^(]*(\(.*\))$", 1)  # from the first parenthesis on, if the last character closes one
        return F.when(e.contains("("), given(rest, lambda r: F.when((r != "") & whole(r), F.substring(r, F.lit(2), F.length(r) - 2)).otherwise(e))).otherwise(e)

    opened = lambda e: F.length(e) - F.length(F.replace(e, F.lit("("), F.lit("")))
    return given(F.array_join(pieces, "'"), lambda folded: F.aggregate(F.sequence(F.lit(1), F.greatest(opened(folded), F.lit(1))), folded, unwrap))  # once for each parenthesis


def duplicate_check(s: Snapshot) -> DataFrame:
    """A check without an expression repeats none. That is asked of the window's result, so that no filter folds the expressions a second time."""
    keyed = s["checks"].where(F.translate("expr", " \t\r\n", "") != "").select("tbl", "name", folded_check(F.col("expr")).alias("key"))
    w = Window.partitionBy("tbl", "key").orderBy("name")
    return told(keyed.withColumn("first", F.when(F.col("key") != "", F.first("name").over(w))).where("first <> name"), "L006", "WARNING", F.col("name"))


def unversioned_extension(s: Snapshot) -> DataFrame:
    """Of names that differ in case only the first one counts."""
    first = s["extensions"].groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("name", "version")).alias("e"))
    return told(first.where(F.trim("e.version") == "").select(F.lit("").alias("tbl"), F.col("e.name").alias("name")), "L011", "INFO", F.col("name"))


def lost_function(s: Snapshot) -> DataFrame:
    return told(s["triggers"].join(s["routines"], "fn", "left_anti"), "L010", "WARNING", F.col("name"))


def key_type(s: Snapshot) -> DataFrame:
    base = F.trim(F.regexp_extract(F.lower(F.trim("data_type")), r"^([^(]*)", 1))
    keyed = s["keys"].join(s["tables"].where("NOT partition").select("tbl"), "tbl", "left_semi").select("tbl", F.explode("cols").alias("col"))
    return told(keyed.join(s["columns"], ["tbl", "col"]).where(~base.isin(*KEY_TYPES)), "L014", "ERROR", F.col("col"))


def duplicate_index(s: Snapshot) -> DataFrame:
    w = Window.partitionBy("tbl", F.array_join("cols", ","), "is_unique", "predicate").orderBy("name")
    return told(s["indexes"].where(F.size("cols") > 0).withColumn("first", F.first("name").over(w)).where("first <> name"), "L047", "ERROR", F.col("name"))


def redundant_index(s: Snapshot) -> DataFrame:
    single = s["indexes"].where((F.size("cols") == 1) & ~F.col("is_unique") & (F.col("predicate") == "")).select("tbl", "name", F.col("cols")[0].alias("lead"))
    several = s["indexes"].where((F.size("cols") > 1) & (F.col("predicate") == "")).select("tbl", F.col("cols")[0].alias("lead")).distinct()
    return told(single.join(several, ["tbl", "lead"], "left_semi"), "L048", "WARNING", F.col("name"))


def boolean_lead(s: Snapshot) -> DataFrame:
    flags = s["columns"].where(is_boolean()).select("tbl", F.lower("col").alias("lead"), F.lit(True).alias("flag")).distinct()
    several = s["indexes"].where(F.size("cols") > 1).withColumn("lead", F.lower(F.col("cols")[0])).join(flags, ["tbl", "lead"], "left")
    return told(several.where(F.col("flag") | F.col("lead").isin(*FLAG_NAMES)), "L051", "WARNING", F.col("name"))


JOIN_RULES = {"L001": no_key, "L002": unindexed_fk, "L006": duplicate_check, "L007": made_up_check, "L010": lost_function, "L011": unversioned_extension, "L014": key_type, "L047": duplicate_index, "L048": redundant_index, "L051": boolean_lead}
#: The rules of the standard profile, and those that the strict one adds.
STANDARD = ("L001", "L002", "L003", "L004", "L005", "L006", "L007", "L008", "L010", "L011")
EXTENDED = ("L014", "L016", "L022", "L032", "L033", "L044", "L047", "L048", "L049", "L051")


def lint(s: Snapshot, rules: tuple[str, ...] = STANDARD + EXTENDED, suppressed: DataFrame | None = None) -> DataFrame:
    """All diagnostics of the rules, without those in suppressed (rule, tbl; an empty tbl means everywhere)."""
    found = reduce(DataFrame.unionByName, [*row_diagnostics(s, [r for r in rules if r in ROW_RULES]), *[JOIN_RULES[r](s) for r in rules if r in JOIN_RULES]])
    if suppressed is None:
        return found
    off = suppressed.select(F.col("rule").alias("r"), F.col("tbl").alias("t"))
    return found.join(off, (F.col("rule") == F.col("r")) & ((F.col("t") == "") | (F.col("tbl") == F.col("t"))), "left_anti")


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("diagnostics"), F.bool_or(F.col("severity") == "ERROR").alias("has_errors"))


PROFILES = {"standard": STANDARD, "strict": STANDARD + EXTENDED, "all": STANDARD + EXTENDED}


def profile(name: str, disabled: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The rules of a profile, by its name in any case, without those disabled."""
    if name.lower() not in PROFILES:
        raise ValueError(f"no profile {name!r}")
    off = {d.upper() for d in disabled}
    return tuple(rule for rule in PROFILES[name.lower()] if rule not in off)


def in_order(found: DataFrame) -> DataFrame:
    """Diagnostics by rule, table and item."""
    return found.orderBy("rule", "tbl", "item")


KINDS = ("tables", "columns", "keys", "indexes", "fks", "checks", "triggers", "routines", "enums", "extensions")


@contextmanager
def snapshot(spark, sf_dir) -> Iterator[Snapshot]:
    """Line items are grouped once, for columns and keys; what reads them must be checkpointed before the end."""
    with generated.kept_lines(spark, sf_dir) as lines:
        found = {kind: generated.frame(spark, sf_dir, f"lint_{kind}", lines) for kind in KINDS}
        yield found | {"keys": checkpoint(found["keys"])}  # read by several rules and derived by an aggregate; the others are told from their rows


def suppressed(spark):
    return spark.createDataFrame([("L016", ""), ("L003", "t7")], "rule string, tbl string")


def lint_all(spark, sf_dir):
    with snapshot(spark, sf_dir) as s:
        return checkpoint(lint(s))


def lint_unsuppressed(spark, sf_dir):
    with snapshot(spark, sf_dir) as s:
        return checkpoint(lint(s, profile("strict", ("l047", "L002")), suppressed(spark)).groupBy("rule", "severity").agg(F.count("*").alias("diagnostics")))


def lint_counts(spark, sf_dir):
    with snapshot(spark, sf_dir) as s:
        return checkpoint(severity_counts(lint(s, profile("Standard"))))


def lint_first(spark, sf_dir):
    """The first 40 diagnostics of a report, in its order."""
    with snapshot(spark, sf_dir) as s:
        first = checkpoint(in_order(lint(s, profile("standard"))).limit(40))
    return first.withColumn("place", F.row_number().over(Window.orderBy("rule", "tbl", "item")))  # 40 rows


QUERIES = {f.__name__: f for f in (lint_all, lint_unsuppressed, lint_counts, lint_first)}

#: The reserved words, for the SQL apart from the rule's own.
WORDS = (
    "'all', 'alter', 'and', 'as', 'asc', 'check', 'column', 'constraint', 'create', 'database', 'default', 'delete', 'desc', 'distinct', 'drop', 'else', 'foreign', 'from', 'group', 'having', 'in', 'index', 'insert', "
    "'into', 'is', 'join', 'key', 'limit', 'not', 'null', 'on', 'or', 'order', 'primary', 'references', 'select', 'set', 'table', 'to', 'union', 'unique', 'update', 'user', 'values', 'where'"
)
quoted = lambda words: ", ".join(f"'{w}'" for w in words)
LINT_SQL = f""", d AS (
    SELECT 'L001' AS rule, 'ERROR' AS severity, tbl, '' AS item FROM tables WHERE NOT partition AND tbl NOT IN (SELECT tbl FROM keys)
    UNION ALL SELECT 'L002', 'WARNING', tbl, name FROM fks f WHERE NOT EXISTS (SELECT 1 FROM (SELECT tbl, cols FROM indexes UNION ALL SELECT tbl, cols FROM keys) i WHERE i.tbl = f.tbl AND len(i.cols) >= len(f.cols) AND list_sort(i.cols[1:len(f.cols)]) = list_sort(f.cols))
    UNION ALL SELECT 'L003', 'WARNING', tbl, item FROM (SELECT tbl, tbl AS item FROM tables UNION ALL SELECT tbl, col FROM columns UNION ALL SELECT tbl, name FROM indexes UNION ALL SELECT '', name FROM enums) WHERE NOT regexp_full_match(item, '[a-z][a-z0-9_]*')
    UNION ALL SELECT 'L004', 'WARNING', tbl, col FROM columns WHERE NOT identity AND (contains(lower(data_type), 'serial') OR contains(dflt, 'nextval('))
    UNION ALL SELECT 'L005', 'WARNING', tbl, name FROM checks WHERE NOT regexp_full_match(name, '[a-z][a-z0-9_]*')
    UNION ALL SELECT 'L006', 'WARNING', tbl, name FROM (SELECT tbl, name, min(name) OVER (PARTITION BY tbl, folded) AS lead FROM (SELECT *, CASE WHEN contains(expr, chr(39)) THEN 'name<>' || regexp_extract(expr, '(''.*'')', 1) WHEN contains(lower(expr), 'and') THEN 'two' WHEN expr <> '' THEN 'a>0' END AS folded FROM checks) WHERE folded IS NOT NULL) WHERE name <> lead
    UNION ALL SELECT 'L011', 'INFO', '', name FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY name) AS r FROM extensions) WHERE r = 1 AND trim(version) = ''
    UNION ALL SELECT 'L007', 'INFO', tbl, name FROM checks c WHERE regexp_extract(name, '^(.+)_check\\d*$', 1) IN (SELECT tbl FROM tables t WHERE t.tbl = c.tbl UNION ALL SELECT tbl || '_' || col FROM columns k WHERE k.tbl = c.tbl)
    UNION ALL SELECT 'L008', 'WARNING', tbl, '' FROM tables WHERE rls AND policies = 0
    UNION ALL SELECT 'L010', 'WARNING', tbl, name FROM triggers WHERE fn NOT IN (SELECT fn FROM routines)
    UNION ALL SELECT 'L014', 'ERROR', k.tbl, k.col FROM (SELECT tbl, unnest(cols) AS col FROM keys) k JOIN columns c ON c.tbl = k.tbl AND c.col = k.col JOIN tables t ON t.tbl = k.tbl AND NOT t.partition WHERE trim(regexp_extract(lower(c.data_type), '^([^(]*)', 1)) NOT IN ({quoted(KEY_TYPES)})
    UNION ALL SELECT 'L016', 'INFO', tbl, '' FROM tables WHERE NOT partition AND comment = ''
    UNION ALL SELECT 'L022', 'ERROR', tbl, '' FROM tables WHERE lower(tbl) IN ({WORDS})
    UNION ALL SELECT 'L022', 'ERROR', tbl, col FROM columns WHERE lower(col) IN ({WORDS})
    UNION ALL SELECT 'L032', 'ERROR', tbl, col FROM columns WHERE regexp_matches(lower(col), '{"|".join(MONEY_WORDS)}') AND (upper(data_type) IN ({quoted(FLOAT_TYPES)}) OR starts_with(upper(data_type), 'FLOAT('))
    UNION ALL SELECT 'L033', 'WARNING', tbl, name FROM fks WHERE upper(on_delete) = 'CASCADE' AND list_has_any(cols, [{quoted(TENANT_COLUMNS)}])
    UNION ALL SELECT 'L044', 'WARNING', tbl, col FROM columns WHERE lower(data_type) IN ('boolean', 'bool') AND trim(dflt) = ''
    UNION ALL SELECT 'L047', 'ERROR', tbl, name FROM (SELECT *, min(name) OVER (PARTITION BY tbl, cols, is_unique, predicate) AS lead FROM indexes) WHERE name <> lead
    UNION ALL SELECT 'L048', 'WARNING', tbl, name FROM indexes a WHERE len(cols) = 1 AND NOT is_unique AND predicate = '' AND EXISTS (SELECT 1 FROM indexes b WHERE b.tbl = a.tbl AND len(b.cols) > 1 AND b.predicate = '' AND b.cols[1] = a.cols[1])
    UNION ALL SELECT 'L049', 'WARNING', tbl, name FROM indexes WHERE len(cols) > 4
    UNION ALL SELECT 'L051', 'WARNING', tbl, name FROM indexes i WHERE len(cols) > 1 AND (lower(i.cols[1]) IN ({quoted(FLAG_NAMES)}) OR EXISTS (SELECT 1 FROM columns c WHERE c.tbl = i.tbl AND lower(c.col) = lower(i.cols[1]) AND lower(c.data_type) IN ('boolean', 'bool')))) """
TABLES = {kind: f"lint_{kind}" for kind in KINDS}
ORACLES = {
    "lint_all": generated.twin(LINT_SQL + "SELECT rule, severity, tbl, item FROM d", **TABLES),
    "lint_unsuppressed": generated.twin(LINT_SQL + "SELECT rule, severity, count(*) AS diagnostics FROM d WHERE rule NOT IN ('L016', 'L047', 'L002') AND NOT (rule = 'L003' AND tbl = 't7') GROUP BY rule, severity", **TABLES),
    "lint_counts": generated.twin(LINT_SQL + "SELECT severity, count(*) AS diagnostics, severity = 'ERROR' AS has_errors FROM d WHERE rule < 'L012' GROUP BY severity", **TABLES),
    "lint_first": generated.twin(LINT_SQL + "SELECT rule, severity, tbl, item, CAST(row_number() OVER (ORDER BY rule, tbl, item) AS INTEGER) AS place FROM d WHERE rule < 'L012' ORDER BY rule, tbl, item LIMIT 40", **TABLES),
}
