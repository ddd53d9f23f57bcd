"""DuckDB expressions for what the Column functions on types, defaults and checks say, written from their definitions."""

from __future__ import annotations


def normal_type(t: str) -> str:
    low = f"lower(trim({t}))"
    return f"""CASE WHEN {low} IN ('int', 'int4', 'serial', 'integer') THEN 'integer' WHEN {low} IN ('int8', 'bigserial', 'bigint') THEN 'bigint' WHEN {low} IN ('int2', 'smallserial', 'smallint') THEN 'smallint'
        WHEN {low} = 'bool' THEN 'boolean' WHEN {low} = 'float8' THEN 'double precision' WHEN {low} = 'float4' THEN 'real' WHEN {low} = 'decimal' THEN 'numeric'
        WHEN {low} = 'timestamp with time zone' THEN 'timestamptz' WHEN {low} = 'timestamp without time zone' THEN 'timestamp' WHEN {low} = 'time with time zone' THEN 'timetz' WHEN {low} = 'time without time zone' THEN 'time'
        WHEN starts_with({low}, 'character varying') THEN 'varchar' || substring({low}, 18) WHEN starts_with({low}, 'character(') THEN 'char' || substring({low}, 10) ELSE {low} END"""


def type_class(t: str) -> str:
    """Of a canonical type: i, f, s, n, or the type itself where nothing is known of it."""
    return f"""CASE WHEN {t} IN ('smallint', 'integer', 'bigint') THEN 'i' WHEN {t} IN ('real', 'double precision') THEN 'f' WHEN {t} IN ('text', 'varchar') OR regexp_full_match({t}, '(varchar|char)\\(\\d+\\)') THEN 's'
        WHEN {t} = 'numeric' OR regexp_full_match({t}, 'numeric\\( *\\d+ *(, *\\d+ *)?\\)') THEN 'n' ELSE '?' || {t} END"""


def type_width(t: str) -> str:
    return f"CASE {t} WHEN 'smallint' THEN 1 WHEN 'integer' THEN 2 WHEN 'bigint' THEN 3 WHEN 'real' THEN 1 WHEN 'double precision' THEN 2 WHEN 'text' THEN 1e9 WHEN 'varchar' THEN 1e9 WHEN 'numeric' THEN 1e9 ELSE TRY_CAST(regexp_extract({t}, '(\\d+)', 1) AS DOUBLE) END"


def type_scale(t: str) -> str:
    return f"CASE WHEN {t} = 'numeric' THEN 1e9 WHEN contains({t}, ',') THEN TRY_CAST(trim(regexp_extract({t}, ',([ 0-9]+)', 1)) AS DOUBLE) ELSE 0 END"


def narrowing(a: str, b: str) -> str:
    """Whether canonical type a becomes a narrower b."""
    x, y = type_class(a), type_class(b)
    return f"""CASE WHEN {a} = {b} THEN false WHEN {x} = {y} AND {x} IN ('i', 'f', 's') THEN {type_width(b)} < {type_width(a)}
        WHEN {x} = 'n' AND {y} = 'n' THEN {type_width(b)} < {type_width(a)} OR {type_scale(b)} < {type_scale(a)} ELSE {x} || {y} NOT IN ('if', 'is', 'fs', 'in') END"""


def plain_default(d: str) -> str:
    bare = f"trim(trim({d}), '() ')"
    return f"""CASE WHEN lower({bare}) IN ('true', 'false') THEN lower({bare}) WHEN regexp_full_match({bare}, '-?\\d+(\\.\\d+)?') THEN {bare}
        WHEN lower({bare}) IN ('current_timestamp', 'now') THEN 'now()'
        WHEN regexp_full_match(trim({d}), '\\(*''([^'']|'''')*''(::[A-Za-z_][A-Za-z0-9_ ]*(\\(\\d+\\))?)?\\)*') THEN regexp_extract({d}, '(''([^'']|'''')*'')', 1)
        WHEN regexp_matches({d}, '^\\(*nextval\\(') THEN 'nextval(''' || regexp_extract({d}, '([^''.]*)''::', 1) || '''::regclass)' ELSE trim({d}) END"""


def made_up_check(name: str, sch: str, tbl: str, columns: str) -> str:
    """Whether a check's name is made up for its table, or for a column that the relation columns has."""
    prefix = f"regexp_extract({name}, '^(.+)_check\\d*$', 1)"
    return f"({prefix} <> '' AND ({prefix} = {tbl} OR {prefix} IN (SELECT k.tbl || '_' || k.col FROM {columns} k WHERE k.tbl = {tbl}{sch})))"
