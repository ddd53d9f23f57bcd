"""Differences of the other kinds of objects: extensions, types, domains, routines, row security, partitions, replication, roles.

Every operator is a full outer join of two snapshots and a rule that gives an object's steps in order; guards return the rows that
a plan has to refuse. Snapshots with a column sch are compared schema by schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalpa.functions import sqltypes
from catalpa.plans import generated, twins
from catalpa.plans.changes import added, paired, removed, scoped

ACTS = "array<struct<change_type:string,destructive:boolean,item:string>>"


def act(change_type: Column | str, destructive: bool | Column = False, item: Column | str = "") -> Column:
    kind = F.lit(change_type) if isinstance(change_type, str) else change_type
    risk = F.lit(destructive) if isinstance(destructive, bool) else destructive
    return F.struct(kind.alias("change_type"), risk.alias("destructive"), (F.lit(item) if isinstance(item, str) else item).alias("item"))


def no_acts() -> Column:
    return F.array().cast(ACTS)


def stepped(both: DataFrame, key: list[str], acts: Column) -> DataFrame:
    """key, seq, change_type, destructive, item: a row for each step of an object."""
    return both.select(*key, F.posexplode(acts).alias("seq", "a")).select(*key, "seq", "a.change_type", "a.destructive", "a.item")


def extension_changes(live: DataFrame, desired: DataFrame) -> DataFrame:
    """CREATE_EXTENSION of what is wanted and not there; others may own what is there, so nothing is dropped."""
    return desired.join(live, scoped(live, "name"), "left_anti").select(*scoped(live, "name"), F.lit("CREATE_EXTENSION").alias("change_type"))


def range_changes(live: DataFrame, desired: DataFrame) -> DataFrame:
    """Range types (name, data_type of the bounds): another subtype means to drop and create."""
    key = scoped(live, "name")
    both = paired(live, desired, key)
    same = sqltypes.normalize_type(F.col("live.data_type")).eqNullSafe(sqltypes.normalize_type(F.col("desired.data_type")))
    acts = F.when(added(), F.array(act("CREATE_RANGE_TYPE"))).when(removed(), F.array(act("DROP_RANGE_TYPE", True))).when(same, no_acts()).otherwise(F.array(act("DROP_RANGE_RETYPE", True), act("CREATE_RANGE_TYPE")))
    return stepped(both, key, acts)


def composite_changes(live: DataFrame, desired: DataFrame) -> DataFrame:
    """Composite types (name, attr, data_type): attributes are dropped, added or retyped, dropping and retyping is destructive."""
    key = scoped(live, "name")
    both = paired(live, desired, [*key, "attr"])
    w = Window.partitionBy(*key)
    both = both.withColumns({"was": F.max((~added()).cast("int")).over(w) == 1, "stays": F.max((~removed()).cast("int")).over(w) == 1, "first": F.min("attr").over(w) == F.col("attr")})
    same = sqltypes.normalize_type(F.col("live.data_type")).eqNullSafe(sqltypes.normalize_type(F.col("desired.data_type")))
    alter = lambda destructive: F.array(act("ALTER_COMPOSITE_TYPE", destructive, F.col("attr")))
    whole = F.when(~F.col("was"), F.array(act("CREATE_COMPOSITE_TYPE"))).otherwise(F.array(act("DROP_COMPOSITE_TYPE", True)))
    acts = F.when(F.col("was") & F.col("stays"), F.when(added(), alter(False)).when(removed(), alter(True)).when(same, no_acts()).otherwise(alter(True))).when(F.col("first"), whole).otherwise(no_acts())
    return stepped(both, key, acts)


def argument_types(args: Column) -> Column:
    """Argument types with one blank between them, each by its canonical name."""
    return F.array_join(F.transform(F.split(args, ","), lambda a: sqltypes.normalize_type(a)), ", ")


def routine_changes(live: DataFrame, desired: DataFrame) -> DataFrame:
    """Routines (name, args, returns, kind, language, definition), told apart by name and argument types.

    Another result, kind or language means to drop and create; another body is replaced in place, but for aggregates. item is
    'signature' where a routine of the name goes on with other arguments or another result.
    """
    key = scoped(live, "name", "args")
    live, desired = (s.withColumns({"args": argument_types(F.col("args")), "returns": sqltypes.normalize_type(F.col("returns"))}) for s in (live, desired))
    named = desired.select(*scoped(live, "name")).distinct().withColumn("goes_on", F.lit(True))
    both = paired(live, desired, key).join(named, scoped(live, "name"), "left")
    a, b = F.col("live"), F.col("desired")
    what = lambda side: F.when(side["kind"] == "AGGREGATE", "AGGREGATE").otherwise("FUNCTION")
    drop, create = lambda note: act(F.concat(F.lit("DROP_"), what(a)), True, note), act(F.concat(F.lit("CREATE_"), what(b)))
    signature = (~a["returns"].eqNullSafe(b["returns"])) | (~a["kind"].eqNullSafe(b["kind"])) | (~a["language"].eqNullSafe(b["language"]))
    acts = (
        F.when(added(), F.array(create))
        .when(removed(), F.array(drop(F.when(F.col("goes_on"), "signature").otherwise(""))))
        .when(signature | ((~a["definition"].eqNullSafe(b["definition"])) & (b["kind"] == "AGGREGATE")), F.array(drop("signature"), create))
        .when(~a["definition"].eqNullSafe(b["definition"]), F.array(create))
        .otherwise(no_acts())
    )
    return stepped(both, key, acts)


def domain_changes(live: DataFrame, desired: DataFrame) -> DataFrame:
    """Domains (name, base, nullable, dflt): another base, nullability or default means to drop and create."""
    key = scoped(live, "name")
    both = paired(live, desired, key)
    a, b = F.col("live"), F.col("desired")
    same = a["base"].eqNullSafe(b["base"]) & a["nullable"].eqNullSafe(b["nullable"]) & a["dflt"].eqNullSafe(b["dflt"])
    return stepped(both, key, F.when(added(), F.array(act("CREATE_DOMAIN"))).when(removed(), F.array(act("DROP_DOMAIN", True))).when(same, no_acts()).otherwise(F.array(act("DROP_DOMAIN_RETYPE", True), act("CREATE_DOMAIN"))))


def domain_check_changes(live: DataFrame, desired: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Checks (name, check_name, check_expr) of domains that both sides have and that aren't rebuilt: a changed check is dropped and added."""
    at = scoped(live, "name")
    stays = live.select(*at).distinct().join(desired.select(*at).distinct(), at).join(rebuilt.select(*at), at, "left_anti")
    live, desired = (s.where("check_name <> ''").join(stays, at, "left_semi").select(*at, "check_name", "check_expr") for s in (live, desired))
    both = paired(live, desired, [*at, "check_name"])
    drop, add = act("DROP_DOMAIN_CONSTRAINT", True, F.col("check_name")), act("ALTER_DOMAIN", False, F.col("check_name"))
    acts = F.when(added(), F.array(add)).when(removed(), F.array(drop)).when(F.col("live.check_expr").eqNullSafe(F.col("desired.check_expr")), no_acts()).otherwise(F.array(drop, add))
    return stepped(both, at, acts)


def rls_changes(live: DataFrame, desired: DataFrame) -> DataFrame:
    """Row security switched on or off, forced or not (tbl, rls, forced), in the tables that are wanted."""
    key = scoped(live, "tbl")
    both = paired(live, desired, key).where(~removed())
    turn = lambda flag, on, off: F.when(F.col(f"desired.{flag}") & ~F.coalesce(F.col(f"live.{flag}"), F.lit(False)), act(on)).when(~F.col(f"desired.{flag}") & F.coalesce(F.col(f"live.{flag}"), F.lit(False)), act(off))
    return stepped(both, key, F.array_compact(F.array(turn("rls", "ENABLE_RLS", "DISABLE_RLS"), turn("forced", "FORCE_RLS", "NO_FORCE_RLS"))))


def refused_conversions(live: DataFrame, desired: DataFrame) -> DataFrame:
    """Tables (tbl, strategy, part_cols; no strategy: not partitioned) that a plan would have to turn into another kind, which it can't."""
    key = scoped(live, "tbl")
    both = paired(live, desired, key).where(~added() & ~removed())
    a, b = F.col("live"), F.col("desired")
    kind = F.when((a["strategy"] == "") != (b["strategy"] == ""), "conversion").when((~a["strategy"].eqNullSafe(b["strategy"])) | (~a["part_cols"].eqNullSafe(b["part_cols"])), "strategy or key")
    return both.select(*key, kind.alias("refused")).where("refused IS NOT NULL")


def partition_changes(live: DataFrame, desired: DataFrame) -> DataFrame:
    """Attach and detach (tbl, parent, bounds, pending; no parent: no partition); a detach that was cut off is ended first.

    item of a detach is 'pending' where it ends one that was cut off, else 'default' where the parent has, on either side, a partition for all other rows.
    """
    key, up = scoped(live, "tbl"), scoped(live, "parent")
    default = lambda s: s.where(F.col("parent") != "").where(F.upper("bounds").contains("DEFAULT")).select(*up)
    with_default = default(live).unionByName(default(desired)).distinct().select(*[F.col(c).alias(f"d_{c}") for c in up], F.lit("default").alias("kept"))
    both = paired(live, desired, key).where(~added() & ~removed())
    a, b = F.col("live"), F.col("desired")
    both = both.join(with_default, [a["parent"] == F.col("d_parent"), *([F.col("sch") == F.col("d_sch")] if "sch" in key else [])], "left")
    detach, attach = act("DETACH_PARTITION", False, F.coalesce("kept", F.lit(""))), act("ATTACH_PARTITION")
    moved = (~a["parent"].eqNullSafe(b["parent"])) | (~a["bounds"].eqNullSafe(b["bounds"]))
    acts = (
        F.when((a["parent"] == "") & (b["parent"] != ""), F.array(attach))
        .when((a["parent"] != "") & (b["parent"] == ""), F.array(detach))
        .when((a["parent"] == "") & (b["parent"] == ""), no_acts())
        .otherwise(F.concat(F.when(a["pending"], F.array(act("DETACH_PARTITION", False, F.lit("pending")))).otherwise(no_acts()), F.when(moved, F.array(detach, attach)).otherwise(no_acts())))
    )
    return stepped(both, key, acts)


def uncovered_partition_keys(tables: DataFrame, unique_sets: DataFrame) -> DataFrame:
    """Primary keys and unique indexes (tbl, name, cols) of partitioned tables (tbl, part_cols) that lack columns of the partition key."""
    joined = tables.where(F.size("part_cols") > 0).join(unique_sets.where(F.size("cols") > 0), scoped(tables, "tbl"))
    return joined.select(*scoped(tables, "tbl"), "name", F.array_join(F.array_except("part_cols", "cols"), ",").alias("lacks")).where("lacks <> ''")


def led_by_key(keys: DataFrame, indexes: DataFrame) -> DataFrame:
    """keys (tbl, key) with whether an index (tbl, cols) begins with the key's columns in their order."""
    at = scoped(keys, "tbl")
    lead = keys.join(indexes.select(*at, "cols"), at).where(F.slice("cols", 1, F.size("key")) == F.col("key")).select(*at).distinct().withColumn("led", F.lit(True))
    return keys.join(lead, at, "left").withColumn("led", F.coalesce("led", F.lit(False)))


#: The least and greatest numbers of the types that a sequence can have.
LIMITS = {"smallint": (-(2**15), 2**15 - 1), "integer": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}


def filled_sequence(s: DataFrame) -> DataFrame:
    """Sequences with what isn't said filled in: steps of 1, a cache of 1, and the limits of the type on the side the steps go to, 1 or -1 on the other."""
    kind = sqltypes.normalize_type(F.when(F.col("data_type") == "", "bigint").otherwise(F.col("data_type")))
    limits = F.coalesce(*[F.create_map(*[x for name, (low, high) in LIMITS.items() for x in (F.lit(name), F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")))])[k] for k in (kind, F.lit("bigint"))])
    s = s.withColumn("step", F.when(F.col("step") == 0, 1).otherwise(F.col("step")))
    up = F.col("step") > 0
    return s.withColumns({"low": F.coalesce("low", F.when(up, F.lit(1)).otherwise(limits["low"])), "high": F.coalesce("high", F.when(up, limits["high"]).otherwise(F.lit(-1))), "cache": F.greatest("cache", F.lit(1))})


def sequence_changes(live: DataFrame, desired: DataFrame) -> DataFrame:
    """Sequences (name, data_type, step, low, high, cache, cycle, owner_tbl, owner_col, implicit, unmanaged).

    A serial column's own (implicit) sequence comes and goes with its table; one with an owner is given to it by a further step; where a sequence starts and
    its type are no difference; an unmanaged one isn't dropped.
    """
    key = scoped(live, "name")
    both = paired(filled_sequence(live), filled_sequence(desired), key)
    a, b = F.col("live"), F.col("desired")
    differs = F.lit(False)
    for c in ("step", "low", "high", "cache", "cycle", "owner_tbl", "owner_col"):
        differs |= ~a[c].eqNullSafe(b[c])
    owned = (b["owner_tbl"] != "") & (b["owner_col"] != "")
    acts = (
        F.when(added(), F.when(b["implicit"], no_acts()).when(owned, F.array(act("CREATE_SEQUENCE"), act("ALTER_SEQUENCE"))).otherwise(F.array(act("CREATE_SEQUENCE"))))
        .when(removed(), F.when(a["implicit"] | a["unmanaged"], no_acts()).otherwise(F.array(act("DROP_SEQUENCE", True))))
        .when(differs, F.array(act("ALTER_SEQUENCE")))
        .otherwise(no_acts())
    )
    return stepped(both, key, acts)


def implicit_sequences(sequences: DataFrame, columns: DataFrame) -> DataFrame:
    """sequences (name, owner_tbl, owner_col) with whether their owner's default draws from them: a serial column's own, not managed apart."""
    at = scoped(sequences)
    on = [F.col("owner_tbl") == F.col("tbl"), F.col("owner_col") == F.col("col"), *([sequences["sch"] == columns["sch"]] if at else [])]
    joined = sequences.join(columns, on, "left")
    return joined.select(*[sequences[c] for c in at], "name", F.coalesce(F.contains("dflt", "name"), F.lit(False)).alias("implicit"))


def unmanaged_dependants(dropped: DataFrame, protected: DataFrame) -> DataFrame:
    """dropped (tbl, col) with the sorted objects (kind, obj, tbl, col) outside the plan that need it; an empty column stands for any.

    An object counts once however many of its references fit.
    """
    at = scoped(dropped, "tbl")
    refs = protected.withColumnRenamed("col", "ref")
    fits = dropped.join(refs, at).where("col = '' OR ref = '' OR col = ref")
    fits = fits.groupBy(*at, "col", "kind", "obj").agg(F.min("ref").alias("ref"))
    named = F.concat("kind", F.lit(":"), "obj", F.when(F.col("ref") != "", F.concat(F.lit(" (column "), "tbl", F.lit("."), "ref", F.lit(")"))).otherwise(""))
    return fits.groupBy(*at, "col").agg(F.array_join(F.array_sort(F.collect_list(named)), "; ").alias("needed_by"), F.count("*").alias("objects"))


def surviving_triggers(live: DataFrame, desired: DataFrame) -> DataFrame:
    """Triggers (tbl, name, definition) that stay as they are, which a dropped column of their table would break."""
    at = scoped(live, "tbl")
    same = live.join(desired.select(*at, "name", "definition"), [*at, "name", "definition"], "left_semi")
    return same.groupBy(*at).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("trigger:"), "name"))), "; ").alias("triggers"))


def routine_dependants(routines: DataFrame, triggers: DataFrame, views: DataFrame) -> DataFrame:
    """Triggers that call and views that name a routine (name) whose signature changes; each is dropped before and made anew after.

    Views are matched word by word, so the join is on equal names, in any case of letters.
    """
    wanted = routines.select(F.lower("name").alias("routine")).distinct()
    by_trigger = triggers.select(F.lit("TRIGGER").alias("kind"), "tbl", "name", F.lower(sqltypes.trigger_function(F.col("definition"))).alias("routine"))
    words = F.array_distinct(F.transform(F.regexp_extract_all("definition", F.lit(r"\w+"), F.lit(0)), F.lower))
    by_view = views.select(F.lit("VIEW").alias("kind"), F.lit("").alias("tbl"), "name", F.explode(words).alias("routine"))
    hit = by_trigger.unionByName(by_view).join(wanted, "routine", "left_semi").groupBy("kind", "tbl", "name").agg(F.array_join(F.array_sort(F.collect_set("routine")), ",").alias("routines"))
    steps = F.array(F.concat(F.lit("DROP_"), "kind"), F.concat(F.lit("CREATE_"), "kind"))
    return hit.select("kind", "tbl", "name", "routines", F.posexplode(steps).alias("seq", "change_type"))


def members(names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(names, ","), lambda n: n != "")))


def replication_changes(live: DataFrame, desired: DataFrame) -> DataFrame:
    """Publications, event triggers, subscriptions and slots (kind, name, definition, members, stamped, active, asked).

    Only what is stamped as the tool's own is altered or dropped. Members are compared as sets; a publication that loses members is narrowed, which is
    destructive. A slot is never altered, and dropped only if asked for and not in use.
    """
    key = ["kind", "name"]
    both = paired(live.withColumn("members", members(F.col("members"))), desired.withColumn("members", members(F.col("members"))), key)
    a, b, what = F.col("live"), F.col("desired"), F.upper("kind")
    narrowed = (F.col("kind") == "publication") & (F.size(F.array_except(a["members"], b["members"])) > 0)
    differs = (~a["definition"].eqNullSafe(b["definition"])) | ~sqltypes.same_set(a["members"], b["members"])
    slot = F.col("kind") == "replication_slot"
    acts = (
        F.when(added(), F.array(act(F.concat(F.lit("CREATE_"), what))))
        .when(removed(), F.when(F.when(slot, a["asked"] & ~a["active"]).otherwise(a["stamped"]), F.array(act(F.concat(F.lit("DROP_"), what), True))).otherwise(no_acts()))
        .when(differs & a["stamped"] & ~slot, F.array(act(F.concat(F.lit("ALTER_"), what), narrowed)))
        .otherwise(no_acts())
    )
    return stepped(both, key, acts)


def refused_recreates(live: DataFrame, desired: DataFrame) -> DataFrame:
    """Objects that aren't stamped as the tool's own and would have to be dropped and made anew: a plan refuses them."""
    both = paired(live, desired, ["kind", "name"]).where(~added() & ~removed())
    return both.where(~F.col("live.stamped") & ~F.col("live.definition").eqNullSafe(F.col("desired.definition"))).select("kind", "name")


def rebuild_choice(changes: DataFrame, deltas: DataFrame) -> DataFrame:
    """For a database without ALTER COLUMN: (tbl, steps, rebuild) of column changes (tbl, change_type) and tables with other checks (tbl).

    A table whose columns are only renamed, none added or dropped, keeps its rows as they are. Any other dropped, renamed or altered column, and any
    check that comes, goes or changes, asks for a rebuild; added columns alone don't.
    """
    of = lambda kind: F.count_if(F.col("change_type") == f"{kind}_COLUMN").alias(kind)
    by = changes.groupBy("tbl").agg(F.count("*").alias("steps"), *[of(kind) for kind in ("ADD", "DROP", "ALTER", "RENAME")])
    both = by.join(deltas.select("tbl").distinct().withColumn("checks", F.lit(True)), "tbl", "full_outer").fillna(0).fillna(False)
    renamed_only = (F.col("RENAME") > 0) & (F.col("ADD") == 0) & (F.col("DROP") == 0)
    return both.select("tbl", "steps", (~renamed_only & ((F.col("DROP") + F.col("RENAME") + F.col("ALTER") > 0) | F.col("checks"))).alias("rebuild"))


def check_delta(live: DataFrame, desired: DataFrame) -> DataFrame:
    """(tbl, gone, new): sorted names of checks (tbl, name, definition) taken away and added; a changed one is both."""
    both = paired(live, desired, ["tbl", "name"])
    changed = ~F.col("live.definition").eqNullSafe(F.col("desired.definition"))
    names = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("name")))), ",")
    return both.where(changed).groupBy("tbl").agg(names(~added()).alias("gone"), names(~removed()).alias("new"))


def desired_roles(roles: DataFrame, grants: DataFrame) -> DataFrame:
    """Names of all roles declared or granted to, but PUBLIC."""
    return roles.select("role").union(grants.select("grantee")).where(F.upper("role") != "PUBLIC").distinct()


def overlaid(base: DataFrame, over: DataFrame, key: list[str]) -> DataFrame:
    """base with the rows of over in place of those of the same key."""
    return base.join(over.select(*key), key, "left_anti").unionByName(over.select(*base.columns))


def replayed(operations: DataFrame) -> DataFrame:
    """What is left of roles (role, attrs, remark) after CREATE, ALTER and DROP in the order of seq.

    A CREATE begins anew, after a DROP nothing is left until the next CREATE; of later operations the last that says an attribute holds.
    """
    ends = operations.groupBy("role").agg(F.max(F.when(F.col("op") == "DROP", F.col("seq"))).alias("dropped"), F.max(F.when(F.col("op") == "CREATE", F.col("seq"))).alias("created"))
    alive = ends.where("created IS NOT NULL AND (dropped IS NULL OR created > dropped)")
    last = lambda c: F.coalesce(F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("seq"))), F.lit(""))
    return operations.join(alive, "role").where("seq >= created").groupBy("role").agg(last("attrs").alias("attrs"), last("remark").alias("remark"))


def role_changes(live: DataFrame, desired: DataFrame, protected: tuple[str, ...] = ()) -> DataFrame:
    """Roles (role, attrs, remark): created, altered, commented and dropped, but for protected ones."""
    both = paired(live, desired, ["role"]).where(~F.col("role").isin(*protected)) if protected else paired(live, desired, ["role"])
    a, b = F.col("live"), F.col("desired")
    remark = lambda cond: F.when(cond, act("ROLE_COMMENT"))
    acts = (
        F.when(added(), F.array_compact(F.array(act("CREATE_ROLE"), remark(b["remark"] != ""))))
        .when(removed(), F.array(act("DROP_ROLE", True)))
        .otherwise(F.array_compact(F.array(F.when(~a["attrs"].eqNullSafe(b["attrs"]), act("ALTER_ROLE")), remark(~a["remark"].eqNullSafe(b["remark"])))))
    )
    return stepped(both, ["role"], acts)
