"""Column functions on the text of SQL types, defaults and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type names and the names they stand for.
TYPE_ALIASES = {
    "int": "integer",
    "int4": "integer",
    "serial": "integer",
    "int8": "bigint",
    "bigserial": "bigint",
    "int2": "smallint",
    "smallserial": "smallint",
    "bool": "boolean",
    "float8": "double precision",
    "float4": "real",
    "timestamp with time zone": "timestamptz",
    "timestamp without time zone": "timestamp",
    "time with time zone": "timetz",
    "time without time zone": "time",
    "decimal": "numeric",
}
#: Fixed values: (class, width) of the types that have no length or precision of their own.
NUMBERS = {"smallint": ("integer", 1), "integer": ("integer", 2), "bigint": ("integer", 3), "real": ("float", 1), "double precision": ("float", 2)}
#: Every value of the first class can be written in the second.
SAFE = ("integer>float", "integer>numeric", "integer>text", "float>text")
UNBOUNDED = 1_000_000_000


def lookup(c: Column, pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[c]


def normalize_type(c: Column) -> Column:
    """The canonical name of a type; only whole names are replaced, but for the character types."""
    low = F.lower(F.trim(c))
    fixed = F.regexp_replace(low, r"^(char)acter(?: (var)ying|(?=\())", "$2$1")
    return F.coalesce(lookup(fixed, TYPE_ALIASES), fixed)


def measured(t: Column) -> Column:
    """struct<kind, width, scale> of a canonical type: what it can hold, as far as that can be compared; null if it can't."""
    shape = lambda kind, width, scale=0: F.struct(F.lit(kind).alias("kind"), F.lit(width).cast("int").alias("width"), F.lit(scale).cast("int").alias("scale"))
    text = F.regexp_extract(t, r"^(?:varchar|char)\((\d+)\)$", 1)
    precision, scale = (F.regexp_extract(t, r"^numeric\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)$", i) for i in (1, 2))
    bare = {name: shape(kind, width) for name, (kind, width) in NUMBERS.items()} | {name: shape("text", UNBOUNDED) for name in ("text", "varchar")} | {"numeric": shape("numeric", UNBOUNDED, UNBOUNDED)}
    found = F.create_map(*[x for name, what in bare.items() for x in (F.lit(name), what)])[t]
    long = F.when(text != "", F.struct(F.lit("text").alias("kind"), text.cast("int").alias("width"), F.lit(0).alias("scale")))
    exact = F.when(precision != "", F.struct(F.lit("numeric").alias("kind"), precision.cast("int").alias("width"), F.when(scale == "", 0).otherwise(scale.try_cast("int")).alias("scale")))
    return F.coalesce(found, long, exact)


def is_narrowing(old: Column, new: Column) -> Column:
    """Whether values may be lost when a column of the old type becomes the new one; types that can't be compared count as narrowing."""
    a, b = normalize_type(old), normalize_type(new)
    return ~((a == b) | fits(measured(a), measured(b)))


def fits(x: Column, y: Column) -> Column:
    """Whether all values of the first measured type can be written in the second."""
    holds = (x["kind"] == y["kind"]) & (x["width"] <= y["width"]) & (x["scale"] <= y["scale"])
    return F.coalesce(holds | F.concat_ws(">", x["kind"], y["kind"]).isin(*SAFE), F.lit(False))


LITERAL = r"'(?:[^']|'')*'"
CAST = r"::[A-Za-z_][A-Za-z0-9_ ]*(?:\(\d+\))?"


#: The calls and words that a default may consist of, and their normal form.
PLAIN_WORDS = {"true": "true", "false": "false", "current_timestamp": "now()", "now()": "now()"}


def normalize_default(c: Column) -> Column:
    """A default without casts, parentheses and schema names where it is a single literal or call; else as it is.

    Only literals and sequences have quotes, so other defaults meet one pattern, which leaves the word, number or call.
    """
    d, end = F.trim(c), "$(?s:.*)"  # takes the line's end that $ leaves as well
    literal = F.regexp_replace(d, rf"^\(*\s*({LITERAL})(?:{CAST})?\s*\)*{end}", "$1")
    quoted = F.regexp_replace(literal, rf"^\(*nextval\('(?:[^'.]*\.)*([^'.]+)'.*{end}", "nextval('$1'::regclass)")
    bare = F.regexp_replace(d, rf"^\(*\s*((?i:true|false|current_timestamp|now\(\))|-?\d+(?:\.\d+)?)\s*\)*{end}", "$1")
    return F.when(d == "", d).when(d.contains("'"), quoted).otherwise(F.coalesce(lookup(F.lower(bare), PLAIN_WORDS), bare))


def is_snake_case(c: Column) -> Column:
    return c.rlike("^[a-z][a-z0-9_]*$")


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def is_made_up_check(name: Column, tbl: Column, columns: Column) -> Column:
    """Whether a check's name is one that a database makes up for a table or one of its columns (an array)."""
    prefix = F.regexp_extract(name, r"^(.+)_check\d*$", 1)
    return (prefix != "") & ((prefix == tbl) | F.coalesce(F.array_contains(F.transform(columns, lambda c: F.concat(tbl, F.lit("_"), c)), prefix), F.lit(False)))


NAME_PART = r'(?:"(?:[^"]|"")*"|[^".]+)'


def plain_name(part: Column) -> Column:
    """An identifier as it is stored: a quoted one without its quotes, any other in lower case."""
    trimmed = F.trim(part)
    return F.when(trimmed.rlike('^"(?:[^"]|"")*"$'), F.replace(F.regexp_extract(trimmed, '^"(.*)"$', 1), F.lit('""'), F.lit('"'))).otherwise(F.lower(trimmed))


def qualified_name(name: Column) -> Column:
    """The parts of a possibly qualified name, each as it is stored; dots inside quotes belong to a part."""
    return F.transform(F.regexp_extract_all(name, F.lit(NAME_PART), F.lit(0)), plain_name)


def trigger_function(definition: Column) -> Column:
    """The bare name of the function that a trigger's definition executes, empty if it has none."""
    called = F.regexp_extract(definition, r'(?i)\bexecute\s+(?:function|procedure)\s+((?:"[^"]+"|[\w$]+)(?:\.(?:"[^"]+"|[\w$]+))*)\s*\(', 1)
    return F.coalesce(F.try_element_at(qualified_name(called), F.lit(-1)), F.lit(""))


def redacted(sql: Column) -> Column:
    """A statement with the literals of passwords and connection strings blotted out."""
    hidden = F.regexp_replace(sql, r"(?i)(\bpassword\s+)'(?:[^']|'')*'", "$1'***'")
    return F.regexp_replace(hidden, r"(?i)(\bconnection\s+)'(?:[^']|'')*'", "$1'***'")


def glob_pattern(glob: str) -> str | None:
    """An anchored regular expression for *, ?, [class] and backslash escapes; None if the glob is malformed."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(glob):
                return None
            out += re.escape(glob[i])
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            out += "[" + body.replace("\\", "\\\\").replace("[", "\\[") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches_glob(c: Column, glob: str) -> Column:
    pattern = glob_pattern(glob)
    return c == glob if pattern is None else c.rlike(pattern)


#: Tables that extensions own.
EXTENSION_TABLES = ("spatial_ref_sys", "geometry_columns", "geography_columns", "raster_columns", "raster_overviews")


def is_managed(name: Column, includes: tuple[str, ...] = (), excludes: tuple[str, ...] = (), own: tuple[str, ...] = ("migration_ledger",), strict: bool = False) -> Column:
    """Whether a table is in scope: not an extension's or the tool's own, not excluded, and included if anything is."""
    if strict and not includes:
        raise ValueError("a strict scope needs at least one included table")
    managed = ~name.isin(*EXTENSION_TABLES, *own)
    for glob in excludes:
        managed &= ~matches_glob(name, glob)
    if includes:
        wanted = F.lit(False)
        for glob in includes:
            wanted |= matches_glob(name, glob)
        managed &= wanted
    return managed
