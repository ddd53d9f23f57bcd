"""Differences of two snapshots as typed changes: one full outer join for each kind of object, null-safe comparisons.

Snapshots are DataFrames with a row for each object. Where they have a column sch it is part of every key, so that any number
of schemas is compared at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalpa.functions import sqltypes
from catalpa.plans import generated, samples, twins
from catalpa.session import checkpoint, small


def scoped(df: DataFrame, *names: str) -> list[str]:
    """The key names, after the schema if the snapshot tells it."""
    return [*(["sch"] if "sch" in df.columns else []), *names]


def paired(live: DataFrame, desired: DataFrame, key: list[str]) -> DataFrame:
    """key, live and desired structs; the side that has no row is null."""
    rest = [c for c in live.columns if c not in key]
    a, b = live.select(*key, F.struct(*rest).alias("live")), desired.select(*key, F.struct(*rest).alias("desired"))
    return a.join(b, key, "full_outer")


def added() -> Column:
    return F.col("live").isNull()


def removed() -> Column:
    return F.col("desired").isNull()


def table_changes(live: DataFrame, desired: DataFrame, in_scope: Column) -> DataFrame:
    """CREATE_TABLE and DROP_TABLE of the tables (tbl) in scope."""
    key = scoped(live, "tbl")
    both = paired(*(s.select(*key).distinct().withColumn("x", F.lit(1)) for s in (live, desired)), key).where(in_scope)
    return both.select(*key, F.when(added(), "CREATE_TABLE").when(removed(), "DROP_TABLE").alias("change_type"), removed().alias("destructive")).where("change_type IS NOT NULL")


def differing(live: DataFrame, desired: DataFrame, at: list[str], partitions: DataFrame | None) -> DataFrame:
    """The columns that differ, of tables that both sides have: at, col, side (live, desired, both) and what column_changes asks of them."""
    told = ["norm", "nullable", "plain", "generated"]
    row = lambda df, side: df.select(*at, "col", F.lit(side).alias("side"), sqltypes.normalize_type(F.col("data_type")).alias("norm"), "nullable", sqltypes.normalize_default(F.col("dflt")).alias("plain"), "generated")
    rows = row(live, "live").unionByName(row(desired, "desired"))
    if partitions is not None:
        rows = rows.unionByName(partitions.select(*at, F.lit("part").alias("side"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("col", *told)]))
    table = Window.partitionBy(*at).orderBy("col").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    has = lambda side: F.max(F.col("side") == side).over(table)
    here = rows.dropna(subset=at).withColumns({"in_live": has("live"), "in_desired": has("desired"), "in_parts": has("part")}).where("in_live AND in_desired AND NOT in_parts")
    of = lambda side: F.first(F.when(F.col("side") == side, F.struct(*told)), ignorenulls=True).alias(side)
    both = here.groupBy(*at, "col").agg(of("live"), of("desired"))  # in the window's order: no other shuffle or sort
    a, b = F.col("live"), F.col("desired")
    type_differs, null_differs, default_differs, generated_differs = (~a[f].eqNullSafe(b[f]) for f in told)
    found = both.where(added() | removed() | type_differs | null_differs | default_differs | generated_differs)
    side = F.when(added(), "desired").when(removed(), "live").otherwise("both")
    kept = lambda c: F.when(added() | removed() | type_differs, c)
    return found.select(*at, "col", side.alias("side"), type_differs.alias("retyped"), kept(a["norm"]).alias("norm"), kept(b["norm"]).alias("new_norm"), (a["nullable"] & ~b["nullable"]).alias("tightened"), generated_differs.alias("generated"), F.coalesce(~b["nullable"], F.lit(False)).alias("strict"))


def column_changes(live: DataFrame, desired: DataFrame, renames: DataFrame, in_scope: Column, expand: bool = False, partitions: DataFrame | None = None) -> DataFrame:
    """ADD, DROP, ALTER and RENAME of columns in tables that both sides have, but for attached partitions (tbl), whose columns their parent manages.

    With expand a renamed column is added beside the old one, which stays until its values are copied (new_col is the old name then); until then it takes nulls.

    A rename maps `table.column` or, less closely, `column` to a column that is new. Of the columns that map to one new column the first by name is renamed, the others are dropped.
    An old name that is mapped more than once goes to the first new name. A dropped column of the same type as an added one that no rename takes is a rename candidate.
    not_null tells an added or altered column that takes no nulls.

    Both sides go through one shuffle, by table; what differs is kept as narrow rows. live, desired and renames are read before this returns, and not again.
    """
    at = scoped(live, "tbl")
    no = F.lit(False)
    both = checkpoint(differing(live.where(in_scope), desired.where(in_scope), at, partitions))
    altered = both.where("side = 'both'").withColumns({"old_measure": sqltypes.measured(F.col("norm")), "new_measure": sqltypes.measured(F.col("new_norm"))})
    narrows = F.when(F.col("retyped"), ~((F.col("norm") == F.col("new_norm")) | sqltypes.fits(F.col("old_measure"), F.col("new_measure")))).otherwise(no)
    alters = altered.select(*at, "col", F.lit(None).cast("string").alias("new_col"), F.lit("ALTER_COLUMN").alias("change_type"), (narrows | F.col("tightened")).alias("destructive"), narrows.alias("narrowed"), "generated", no.alias("candidate"), F.col("strict").alias("not_null"))
    gone = both.where("side = 'live'").select(*at, "col", "norm")
    new = both.where("side = 'desired'").select(*at, F.col("col").alias("new_col"), "new_norm", "strict")
    named = checkpoint(renames.groupBy("old_name").agg(F.min("new_name").alias("new_name")))
    close = named.select(F.col("old_name").alias("full_name"), F.col("new_name").alias("close"))
    bare = small(checkpoint(gone.select(F.col("col").alias("old_name")).distinct()), F.length("old_name") + 32)  # few names stand for many columns: no shuffle by them
    loose = small(checkpoint(named.join(bare, "old_name", "left_semi")), F.length("old_name") + F.length("new_name") + 32).select(F.col("old_name").alias("bare_name"), F.col("new_name").alias("loose"))
    mapped = gone.join(close, F.concat_ws(".", "tbl", "col") == F.col("full_name"), "left").join(loose, F.col("col") == F.col("bare_name"), "left")
    mapped = mapped.withColumn("new_col", F.coalesce("close", "loose")).join(new.select(*at, "new_col", F.lit(True).alias("is_new")), [*at, "new_col"], "left")
    first = F.row_number().over(Window.partitionBy(*at, "new_col", "is_new").orderBy("col")) == 1
    mapped = mapped.withColumn("takes", F.coalesce(F.col("is_new") & first, no))
    renamed = mapped.where("takes").select(*at, "col", "new_col")
    adds = new.join(renamed.select(*at, "new_col"), [*at, "new_col"], "left_anti")
    open_types = adds.select(*at, F.col("new_norm").alias("norm"), F.lit(True).alias("open")).distinct()
    drops = mapped.where("NOT takes").select(*at, "col", "norm").join(open_types, [*at, "norm"], "left")
    shape = lambda df, kind, col, new_col, destructive, candidate, not_null=no: df.select(*at, col.alias("col"), new_col.alias("new_col"), F.lit(kind).alias("change_type"), F.lit(destructive).alias("destructive"), no.alias("narrowed"), no.alias("generated"), candidate.alias("candidate"), not_null.alias("not_null"))
    none = F.lit(None).cast("string")
    moves = shape(renamed, "ADD_COLUMN", F.col("new_col"), F.col("col"), False, no) if expand else shape(renamed, "RENAME_COLUMN", F.col("col"), F.col("new_col"), False, no)
    return (
        alters.unionByName(moves)
        .unionByName(shape(adds, "ADD_COLUMN", F.col("new_col"), none, False, no, F.col("strict")))
        .unionByName(shape(drops, "DROP_COLUMN", F.col("col"), none, True, F.coalesce("open", no)))
    )


def object_changes(live: DataFrame, desired: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Changes of indexes, keys, checks, triggers, sequences and comments (kind, tbl, name; a column's comment has its name): one row for each step, in order seq.

    Equal but not valid: an index is built anew, a constraint is validated; NOT VALID at its end is no difference. A check whose name is made up for its
    table, or for one of the table's live columns (tbl, col), is never dropped.
    """
    key = scoped(live, "kind", "tbl", "name")
    both = paired(live, desired, key)
    if columns is None:
        both = both.withColumn("cols", F.array().cast("array<string>"))
    else:
        at = scoped(columns.select(*[c for c in columns.columns if c != "sch" or "sch" in key]), "tbl")
        both = both.join(columns.groupBy(*at).agg(F.collect_set("col").alias("cols")), at, "left")
    a, b, kind = F.col("live"), F.col("desired"), F.col("kind")
    what = F.upper(kind)
    plain = lambda d: F.when(kind.isin("fk", "check"), F.regexp_replace(d, r"\s+NOT VALID$", "")).otherwise(d)
    differs = ~plain(a["definition"]).eqNullSafe(plain(b["definition"]))
    create = F.when(kind.isin("fk", "check"), F.concat(F.lit("ADD_"), what)).otherwise(F.concat(F.lit("CREATE_"), what))
    drop = F.concat(F.lit("DROP_"), what)
    made_up = (kind == "check") & sqltypes.is_made_up_check(F.col("name"), F.col("tbl"), F.col("cols"))
    steps = (
        F.when(kind == "comment", F.when(F.coalesce(a["definition"], F.lit("")) != F.coalesce(b["definition"], F.lit("")), F.array(F.when(F.col("name") == "", "COMMENT_TABLE").otherwise("COMMENT_COLUMN"))))
        .when(added(), F.array(create))
        .when(removed(), F.when(~made_up, F.array(drop)))
        .when((kind == "sequence") & differs, F.array(F.lit("ALTER_SEQUENCE")))
        .when(differs | ((kind == "index") & ~a["valid"]), F.array(drop, create))
        .when(kind.isin("fk", "check") & ~a["valid"], F.array(F.lit("VALIDATE_CONSTRAINT")))
    )
    rows = both.select(*key, F.coalesce(a["valid"], F.lit(True)).alias("was_valid"), F.posexplode(steps).alias("seq", "change_type"))
    return rows.select(*key, "seq", "change_type", (F.col("change_type").startswith("DROP_") & ((kind != "index") | F.col("was_valid"))).alias("destructive"))


def enum_changes(live: DataFrame, desired: DataFrame, renames: DataFrame) -> DataFrame:
    """CREATE_ENUM, ALTER_ENUM (a new label), RENAME_ENUM_VALUE, DROP_ENUM_VALUE; the order of labels doesn't count.

    A rename maps `<enum>.<label>` or, where there is none, `enum.<enum>.<label>` to a desired label. Of the labels that map to one the first by position is renamed; the others are
    dropped, if they aren't desired themselves.
    """
    key = scoped(live, "name")
    known = live.select(*key).distinct()
    creates = desired.join(known, key, "left_anti").groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]), ",").alias("label"))
    to = renames.groupBy("old_name").agg(F.min("new_name").alias("to"))
    close, loose = to.select(F.col("old_name").alias("close_name"), F.col("to").alias("close")), to.select(F.col("old_name").alias("loose_name"), F.col("to").alias("loose"))
    said = F.concat("name", F.lit("."), "label")
    mapped = live.join(desired.select(*key).distinct(), key, "left_semi").join(close, said == F.col("close_name"), "left").join(loose, F.concat(F.lit("enum."), said) == F.col("loose_name"), "left").select(*key, "label", "pos", F.coalesce("close", "loose").alias("to"))
    mapped = mapped.join(desired.select(*key, F.col("label").alias("to"), F.lit(True).alias("is_wanted")), [*key, "to"], "left").join(desired.select(*key, "label", F.lit(True).alias("stays")), [*key, "label"], "left")
    fits = F.coalesce(F.col("is_wanted") & (F.col("to") != F.col("label")), F.lit(False))
    first = F.row_number().over(Window.partitionBy(*key, "to", "fits").orderBy("pos", "label")) == 1
    told = checkpoint(mapped.withColumn("fits", fits).withColumn("takes", F.col("fits") & first))
    renamed = told.where("takes").select(*key, "label", "to")
    dropped = told.where("NOT takes AND stays IS NULL").select(*key, "label")
    fresh = desired.join(known, key, "left_semi").join(live.select(*key, "label"), [*key, "label"], "left_anti").join(renamed.select(*key, F.col("to").alias("label")), [*key, "label"], "left_anti")
    kind = lambda df, label, to, change, destructive: df.select(*key, label.alias("label"), to.alias("new_label"), F.lit(change).alias("change_type"), F.lit(destructive).alias("destructive"))
    none = F.lit(None).cast("string")
    return kind(creates, F.col("label"), none, "CREATE_ENUM", False).unionByName(kind(renamed, F.col("label"), F.col("to"), "RENAME_ENUM_VALUE", False)).unionByName(kind(dropped, F.col("label"), none, "DROP_ENUM_VALUE", True)).unionByName(kind(fresh, F.col("label"), none, "ALTER_ENUM", False))


def view_changes(live: DataFrame, desired: DataFrame) -> DataFrame:
    """CREATE, replaced in place where the live columns lead the desired ones, dropped and created otherwise, DROP; a materialised view is filled after."""
    key = scoped(live, "name")
    both = paired(live, desired, key)
    a, b = F.col("live"), F.col("desired")
    leads = F.coalesce(F.slice(b["cols"], 1, F.size(a["cols"])) == a["cols"], F.lit(False))
    in_place = ~a["materialised"] & ~b["materialised"] & leads
    steps = F.when(added() & b["materialised"], F.array(F.lit("CREATE_VIEW"), F.lit("REFRESH_MATVIEW"))).when(added(), F.array(F.lit("CREATE_VIEW"))).when(removed(), F.array(F.lit("DROP_VIEW"))).when(a["definition"].eqNullSafe(b["definition"]) & a["materialised"].eqNullSafe(b["materialised"]), F.array().cast("array<string>")).when(in_place, F.array(F.lit("CREATE_VIEW"))).when(b["materialised"], F.array(F.lit("DROP_VIEW"), F.lit("CREATE_VIEW"), F.lit("REFRESH_MATVIEW"))).otherwise(F.array(F.lit("DROP_VIEW"), F.lit("CREATE_VIEW")))
    return both.select(*key, F.posexplode(steps).alias("seq", "change_type"))


def role_set(roles: Column) -> Column:
    """Roles lower-cased, trimmed and in order; none stands for public."""
    return F.when(F.size(roles) == 0, F.array(F.lit("public"))).otherwise(F.array_sort(F.transform(roles, lambda r: F.lower(F.trim(r)))))


def policy_changes(live: DataFrame, desired: DataFrame) -> DataFrame:
    """CREATE, ALTER, DROP and CREATE where the command or kind changes or an expression is taken away, DROP."""
    live, desired = (s.withColumn("roles", role_set(F.col("roles"))) for s in (live, desired))
    key = scoped(live, "tbl", "name")
    both = paired(live, desired, key)
    a, b = F.col("live"), F.col("desired")
    said = lambda expr: F.coalesce(expr, F.lit("")) != ""
    taken = lambda expr: said(a[expr]) & ~said(b[expr])
    rebuilt = ~a["cmd"].eqNullSafe(b["cmd"]) | ~a["permissive"].eqNullSafe(b["permissive"]) | taken("using_expr") | taken("check_expr")
    steps = F.when(added(), F.array(F.lit("CREATE_POLICY"))).when(removed(), F.array(F.lit("DROP_POLICY"))).when(a.eqNullSafe(b), F.array().cast("array<string>")).when(rebuilt, F.array(F.lit("DROP_POLICY"), F.lit("CREATE_POLICY"))).otherwise(F.array(F.lit("ALTER_POLICY")))
    return both.select(*key, F.posexplode(steps).alias("seq", "change_type"))


#: What ALL stands for, by kind of object.
ALL_PRIVILEGES = {
    "database": ("CONNECT", "CREATE", "TEMPORARY"),
    "function": ("EXECUTE",),
    "schema": ("CREATE", "USAGE"),
    "sequence": ("SELECT", "UPDATE", "USAGE"),
    "table": ("DELETE", "INSERT", "MAINTAIN", "REFERENCES", "SELECT", "TRIGGER", "TRUNCATE", "UPDATE"),
}


def merged_grants(grants: DataFrame) -> DataFrame:
    """One row for each (kind, obj, grantee), by schema where it is told: the union of its privileges, ALL written out, and whether any grant may be passed on."""
    every = F.create_map(*[x for kind, names in ALL_PRIVILEGES.items() for x in (F.lit(kind), F.array(*[F.lit(n) for n in names]))])
    spelled = F.when(F.array_contains(F.transform("privileges", F.upper), "ALL"), F.coalesce(F.try_element_at(every, F.col("kind")), F.col("privileges"))).otherwise(F.transform("privileges", F.upper))
    option = F.bool_or("grantable") if "grantable" in grants.columns else F.lit(False)
    return grants.withColumn("privileges", spelled).groupBy(*scoped(grants, "kind", "obj", "grantee")).agg(F.array_distinct(F.flatten(F.collect_list("privileges"))).alias("privileges"), option.alias("grantable"))


def grant_changes(live: DataFrame, desired: DataFrame) -> DataFrame:
    """GRANT and REVOKE of the privileges missing and surplus; what PUBLIC has isn't revoked.

    Where only the right to pass a grant on is missing, the privileges are granted again.
    """
    key = scoped(live, "kind", "obj", "grantee")
    both = paired(merged_grants(live), merged_grants(desired), key)
    empty = F.array().cast("array<string>")
    have, want = F.coalesce(F.col("live.privileges"), empty), F.coalesce(F.col("desired.privileges"), empty)
    passes = F.coalesce(F.col("desired.grantable") & ~F.col("live.grantable"), F.lit(False))
    missing = F.when(passes, want).otherwise(F.array_except(want, have))
    parts = F.array(F.struct(F.lit("GRANT").alias("change_type"), F.array_sort(missing).alias("p")), F.struct(F.lit("REVOKE").alias("change_type"), F.array_sort(F.array_except(have, want)).alias("p")))
    rows = both.select(*key, F.explode(parts).alias("x")).select(*key, "x.change_type", F.array_join("x.p", ",").alias("privileges"))
    return rows.where("privileges <> '' AND NOT (change_type = 'REVOKE' AND grantee = 'PUBLIC')")


def whole_tables(tables: DataFrame, objects: DataFrame, policies: DataFrame | None = None, rls: DataFrame | None = None) -> DataFrame:
    """Table changes (tbl, change_type) and those of objects, policies (tbl, name, seq, change_type) and row security (tbl, seq, change_type) put together: (tbl, kind, name, seq, change_type).

    What stands in a dropped table goes with it, but its foreign keys are dropped before; what is new in a new table follows it: indexes, keys, checks, row security, policies, triggers, comments.
    """
    at = scoped(objects, "tbl")
    shaped = lambda df, kind, name: df.select(*at, F.lit(kind).alias("kind"), name.alias("name"), "seq", "change_type")
    parts = objects.select(*at, "kind", "name", "seq", "change_type")
    if policies is not None:
        parts = parts.unionByName(shaped(policies, "policy", F.col("name")))
    if rls is not None:
        parts = parts.unionByName(shaped(rls, "rls", F.lit("")))
    gone = tables.where("change_type = 'DROP_TABLE'").select(*at).distinct().withColumn("gone", F.lit(True))
    kept = parts.join(gone, at, "left").where("gone IS NULL OR change_type = 'DROP_FK'").drop("gone")
    own = tables.select(*at, F.lit("table").alias("kind"), F.lit("").alias("name"), F.when(F.col("change_type") == "DROP_TABLE", 1).otherwise(0).alias("seq"), "change_type")
    return kept.unionByName(own)


def diff_expand(spark, sf_dir):
    """Renames as additions, with the old column kept."""
    with generated.kept_lines(spark, sf_dir) as lines:
        live, desired, renames, tables = generated.frames(spark, sf_dir, "live_columns", "desired_columns", "renames", "desired_tables", lines=lines)
        found = column_changes(live, desired, renames, F.lit(True), expand=True, partitions=tables.where("parent <> ''"))
    return found.where("change_type = 'ADD_COLUMN' AND new_col IS NOT NULL").select("sch", "tbl", "col", "new_col", "not_null")


def diff_whole_tables(spark, sf_dir):
    live, desired, live_objects, desired_objects = generated.frames(spark, sf_dir, "live_columns", "desired_columns", "live_objects", "desired_objects")
    return whole_tables(table_changes(live, desired, F.lit(True)), object_changes(live_objects, desired_objects, live))


def diff_tables(spark, sf_dir):
    return table_changes(*generated.frames(spark, sf_dir, "live_columns", "desired_columns"), sqltypes.is_managed(F.col("tbl"), excludes=("t?", "t9*1")))


def diff_columns(spark, sf_dir, lines=None):
    if lines is None:
        with generated.kept_lines(spark, sf_dir) as kept:
            return diff_columns(spark, sf_dir, kept)
    live, desired, renames, tables = generated.frames(spark, sf_dir, "live_columns", "desired_columns", "renames", "desired_tables", lines=lines)
    return column_changes(live, desired, renames, sqltypes.is_managed(F.col("tbl"), includes=("t[0-9]*",), excludes=("t7?",)), partitions=tables.where("parent <> ''"))


def diff_objects(spark, sf_dir):
    live, desired, columns = generated.frames(spark, sf_dir, "live_objects", "desired_objects", "live_columns")
    return object_changes(live, desired, columns)


def diff_enums(spark, sf_dir):
    return enum_changes(*generated.frames(spark, sf_dir, "live_enums", "desired_enums", "enum_renames"))


def diff_views(spark, sf_dir):
    return view_changes(*generated.frames(spark, sf_dir, "live_views", "desired_views"))


def diff_policies(spark, sf_dir):
    return policy_changes(*generated.frames(spark, sf_dir, "live_policies", "desired_policies"))


def diff_grants(spark, sf_dir):
    live, desired = (g.withColumn("privileges", F.split("privileges", ",")) for g in generated.frames(spark, sf_dir, "live_grants", "desired_grants"))
    return grant_changes(live, desired)


QUERIES = {f.__name__: f for f in (diff_tables, diff_columns, diff_objects, diff_enums, diff_views, diff_policies, diff_grants, diff_expand, diff_whole_tables)}


def over(sql: str, **rows: samples.Rows) -> str:
    return "WITH " + ", ".join(r.sql(n) for n, r in rows.items()) + sql


ROLES = "list_sort(list_transform(string_split(CASE WHEN len(roles) = 0 THEN 'public' ELSE array_to_string(roles, ',') END, ','), lambda r: lower(trim(r))))"
ALL_SQL = "CASE WHEN contains(',' || privileges || ',', ',ALL,') THEN CASE kind WHEN 'table' THEN 'DELETE,INSERT,MAINTAIN,REFERENCES,SELECT,TRIGGER,TRUNCATE,UPDATE' WHEN 'sequence' THEN 'SELECT,UPDATE,USAGE' WHEN 'schema' THEN 'CREATE,USAGE' END ELSE privileges END"
ORACLES = {
    "diff_tables": generated.twin(
        """ SELECT coalesce(l.sch, d.sch) AS sch, coalesce(l.tbl, d.tbl) AS tbl, CASE WHEN l.tbl IS NULL THEN 'CREATE_TABLE' ELSE 'DROP_TABLE' END AS change_type, d.tbl IS NULL AS destructive
        FROM (SELECT DISTINCT sch, tbl FROM a) l FULL OUTER JOIN (SELECT DISTINCT sch, tbl FROM b) d ON l.sch = d.sch AND l.tbl = d.tbl
        WHERE (l.tbl IS NULL OR d.tbl IS NULL) AND coalesce(l.tbl, d.tbl) NOT LIKE 't_' AND coalesce(l.tbl, d.tbl) NOT LIKE 't9%1'""", a="live_columns", b="desired_columns"),
    "diff_columns": generated.twin(
        f""", both_have AS (SELECT DISTINCT sch, tbl FROM a WHERE (sch, tbl) IN (SELECT (sch, tbl) FROM b) AND tbl NOT LIKE 't7_' AND (sch, tbl) NOT IN (SELECT (sch, tbl) FROM u WHERE parent <> '')),
        l AS (SELECT *, {twins.normal_type('data_type')} AS norm, {twins.plain_default('dflt')} AS plain FROM a SEMI JOIN both_have USING (sch, tbl)),
        d AS (SELECT *, {twins.normal_type('data_type')} AS norm, {twins.plain_default('dflt')} AS plain FROM b SEMI JOIN both_have USING (sch, tbl)),
        kept AS (SELECT l.sch, l.tbl, l.col, {twins.narrowing('l.norm', 'd.norm')} AS narrows, l.nullable AND NOT d.nullable AS tightens, NOT d.nullable AS strict, l.generated <> d.generated AS regenerated, l.norm <> d.norm OR l.nullable <> d.nullable OR l.plain <> d.plain AS differs FROM l JOIN d USING (sch, tbl, col)),
        gone AS (SELECT * FROM l ANTI JOIN d USING (sch, tbl, col)),
        fresh AS (SELECT * FROM d ANTI JOIN l USING (sch, tbl, col)),
        told AS (SELECT g.sch, g.tbl, g.col, g.norm, coalesce((SELECT min(new_name) FROM r WHERE old_name = g.tbl || '.' || g.col), (SELECT min(new_name) FROM r WHERE old_name = g.col)) AS new_name FROM gone g),
        moved AS (SELECT t.* FROM told t JOIN fresh f ON f.sch = t.sch AND f.tbl = t.tbl AND f.col = t.new_name QUALIFY row_number() OVER (PARTITION BY t.sch, t.tbl, t.new_name ORDER BY t.col) = 1),
        added AS (SELECT f.* FROM fresh f ANTI JOIN moved m ON f.sch = m.sch AND f.tbl = m.tbl AND f.col = m.new_name)
        SELECT sch, tbl, col, NULL AS new_col, 'ALTER_COLUMN' AS change_type, narrows OR tightens AS destructive, narrows AS narrowed, regenerated AS generated, false AS candidate, strict AS not_null FROM kept WHERE differs OR regenerated
        UNION ALL SELECT sch, tbl, col, new_name, 'RENAME_COLUMN', false, false, false, false, false FROM moved
        UNION ALL SELECT sch, tbl, col, NULL, 'ADD_COLUMN', false, false, false, false, NOT nullable FROM added
        UNION ALL SELECT sch, tbl, col, NULL, 'DROP_COLUMN', true, false, false, EXISTS (SELECT 1 FROM added n WHERE n.sch = t.sch AND n.tbl = t.tbl AND n.norm = t.norm), false FROM told t ANTI JOIN moved USING (sch, tbl, col)""", a="live_columns", b="desired_columns", r="renames", u="desired_tables"),
    "diff_objects": generated.twin(
        f""", j AS (SELECT coalesce(a.sch, b.sch) AS sch, coalesce(a.kind, b.kind) AS kind, coalesce(a.tbl, b.tbl) AS tbl, coalesce(a.name, b.name) AS name, a.definition AS was, replace(b.definition, ' NOT VALID', '') AS wants, a.kind IS NULL AS is_new, b.kind IS NULL AS is_gone, coalesce(a.valid, true) AS was_valid
            FROM a FULL OUTER JOIN b ON a.sch = b.sch AND a.kind = b.kind AND a.tbl = b.tbl AND a.name = b.name),
        s AS (SELECT *, CASE WHEN kind = 'comment' THEN CASE WHEN coalesce(was, '') <> coalesce(wants, '') THEN [CASE WHEN name = '' THEN 'COMMENT_TABLE' ELSE 'COMMENT_COLUMN' END] ELSE [] END
            WHEN is_new THEN [CASE WHEN kind IN ('fk', 'check') THEN 'ADD_' ELSE 'CREATE_' END || upper(kind)]
            WHEN is_gone THEN CASE WHEN kind = 'check' AND {twins.made_up_check('name', '', 'j.tbl', 'c')} THEN [] ELSE ['DROP_' || upper(kind)] END
            WHEN kind = 'sequence' AND was <> wants THEN ['ALTER_SEQUENCE']
            WHEN was <> wants OR (kind = 'index' AND NOT was_valid) THEN ['DROP_' || upper(kind), CASE WHEN kind IN ('fk', 'check') THEN 'ADD_' ELSE 'CREATE_' END || upper(kind)]
            WHEN kind IN ('fk', 'check') AND NOT was_valid THEN ['VALIDATE_CONSTRAINT'] ELSE [] END AS steps FROM j),
        u AS (SELECT sch, kind, tbl, name, was_valid, unnest(steps) AS change_type, CAST(unnest(range(len(steps))) AS INTEGER) AS seq FROM s)
        SELECT sch, kind, tbl, name, seq, change_type, starts_with(change_type, 'DROP_') AND (kind <> 'index' OR was_valid) AS destructive FROM u""", a="live_objects", b="desired_objects", c="live_columns"),
    "diff_enums": generated.twin(
        """, m AS (SELECT a.sch, a.name, a.label, a.pos, coalesce((SELECT min(new_name) FROM r WHERE old_name = a.name || '.' || a.label), (SELECT min(new_name) FROM r WHERE old_name = 'enum.' || a.name || '.' || a.label)) AS target FROM a WHERE (sch, name) IN (SELECT (sch, name) FROM b)),
        ren AS (SELECT m.* FROM m JOIN b ON b.sch = m.sch AND b.name = m.name AND b.label = m.target AND m.target <> m.label QUALIFY row_number() OVER (PARTITION BY m.sch, m.name, m.target ORDER BY m.pos, m.label) = 1)
        SELECT sch, name, string_agg(label, ',' ORDER BY pos) AS label, NULL AS new_label, 'CREATE_ENUM' AS change_type, false AS destructive FROM b WHERE (sch, name) NOT IN (SELECT (sch, name) FROM a) GROUP BY sch, name
        UNION ALL SELECT sch, name, label, target, 'RENAME_ENUM_VALUE', false FROM ren
        UNION ALL SELECT sch, name, label, NULL, 'DROP_ENUM_VALUE', true FROM m WHERE (sch, name, label) NOT IN (SELECT (sch, name, label) FROM ren) AND (sch, name, label) NOT IN (SELECT (sch, name, label) FROM b)
        UNION ALL SELECT sch, name, label, NULL, 'ALTER_ENUM', false FROM b WHERE (sch, name) IN (SELECT (sch, name) FROM a) AND (sch, name, label) NOT IN (SELECT (sch, name, label) FROM a) AND (sch, name, label) NOT IN (SELECT (sch, name, target) FROM ren)""", a="live_enums", b="desired_enums", r="enum_renames"),
    "diff_views": generated.twin(
        """, s AS (SELECT coalesce(a.sch, b.sch) AS sch, coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN ['CREATE_VIEW'] || CASE WHEN b.materialised THEN ['REFRESH_MATVIEW'] ELSE [] END WHEN b.name IS NULL THEN ['DROP_VIEW']
            WHEN a.definition IS NOT DISTINCT FROM b.definition AND a.materialised = b.materialised THEN [] WHEN NOT a.materialised AND NOT b.materialised AND b.cols[1:len(a.cols)] = a.cols THEN ['CREATE_VIEW']
            ELSE ['DROP_VIEW', 'CREATE_VIEW'] || CASE WHEN b.materialised THEN ['REFRESH_MATVIEW'] ELSE [] END END AS steps FROM a FULL OUTER JOIN b ON a.sch = b.sch AND a.name = b.name)
        SELECT sch, name, CAST(unnest(range(len(steps))) AS INTEGER) AS seq, unnest(steps) AS change_type FROM s""", a="live_views", b="desired_views"),
    "diff_policies": generated.twin(
        f""", l AS (SELECT * REPLACE ({ROLES} AS roles) FROM a), d AS (SELECT * REPLACE ({ROLES} AS roles) FROM b),
        s AS (SELECT coalesce(l.sch, d.sch) AS sch, coalesce(l.tbl, d.tbl) AS tbl, coalesce(l.name, d.name) AS name, CASE WHEN l.name IS NULL THEN ['CREATE_POLICY'] WHEN d.name IS NULL THEN ['DROP_POLICY']
            WHEN l.cmd <> d.cmd OR l.permissive <> d.permissive OR (l.using_expr <> '' AND d.using_expr = '') OR (l.check_expr <> '' AND d.check_expr = '') THEN ['DROP_POLICY', 'CREATE_POLICY']
            WHEN l.roles <> d.roles OR l.using_expr <> d.using_expr OR l.check_expr <> d.check_expr THEN ['ALTER_POLICY'] ELSE [] END AS steps FROM l FULL OUTER JOIN d ON l.sch = d.sch AND l.tbl = d.tbl AND l.name = d.name)
        SELECT sch, tbl, name, CAST(unnest(range(len(steps))) AS INTEGER) AS seq, unnest(steps) AS change_type FROM s""", a="live_policies", b="desired_policies"),
    "diff_grants": generated.twin(
        f""", l AS (SELECT sch, kind, obj, grantee, unnest(string_split({ALL_SQL}, ',')) AS p, grantable FROM a), d AS (SELECT sch, kind, obj, grantee, unnest(string_split({ALL_SQL}, ',')) AS p, grantable FROM b),
        lm AS (SELECT sch, kind, obj, grantee, list_distinct(list(p)) AS p, bool_or(grantable) AS g FROM l GROUP BY ALL), dm AS (SELECT sch, kind, obj, grantee, list_distinct(list(p)) AS p, bool_or(grantable) AS g FROM d GROUP BY ALL),
        given AS (SELECT d.sch, d.kind, d.obj, d.grantee, 'GRANT' AS change_type, list_filter(d.p, lambda x: (d.g AND NOT l.g) IS TRUE OR l.p IS NULL OR NOT list_contains(l.p, x)) AS p FROM dm d LEFT JOIN lm l USING (sch, kind, obj, grantee)
            UNION ALL SELECT l.sch, l.kind, l.obj, l.grantee, 'REVOKE', list_filter(l.p, lambda x: d.p IS NULL OR NOT list_contains(d.p, x)) FROM lm l LEFT JOIN dm d USING (sch, kind, obj, grantee) WHERE l.grantee <> 'PUBLIC')
        SELECT sch, kind, obj, grantee, change_type, array_to_string(list_sort(p), ',') AS privileges FROM given WHERE len(p) > 0""", a="live_grants", b="desired_grants"),
}
ORACLES["diff_expand"] = ORACLES["diff_columns"].replace("WITH ", "WITH every AS (WITH ", 1).replace(" AND tbl NOT LIKE 't7_'", "") + ") SELECT sch, tbl, new_col AS col, col AS new_col, false AS not_null FROM every WHERE change_type = 'RENAME_COLUMN'"
ORACLES["diff_whole_tables"] = (
    "WITH every AS (" + ORACLES["diff_objects"] + "), " + generated.twin("", la="live_columns", lb="desired_columns").removeprefix("WITH ") + """,
    gone AS (SELECT DISTINCT sch, tbl FROM la ANTI JOIN lb USING (sch, tbl)), fresh AS (SELECT DISTINCT sch, tbl FROM lb ANTI JOIN la USING (sch, tbl))
    SELECT sch, tbl, kind, name, seq, change_type FROM every WHERE (sch, tbl) NOT IN (SELECT (sch, tbl) FROM gone) OR change_type = 'DROP_FK'
    UNION ALL SELECT sch, tbl, 'table', '', 1, 'DROP_TABLE' FROM gone UNION ALL SELECT sch, tbl, 'table', '', 0, 'CREATE_TABLE' FROM fresh"""
)
