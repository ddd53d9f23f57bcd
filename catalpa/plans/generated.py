"""Snapshots of many schemas, live and desired, and plans of many steps, derived from the rows of the tables.

Each is one SELECT over whole tables in the SQL that Spark and DuckDB share, so a query and its SQL twin read the same catalogue. The rows' keys decide
what exists on which side and what differs, so that every rule meets rows that fire it and rows that don't. The number of schemas' tables, plans and objects
grows with the tables, the size of one of them doesn't.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from catalpa.plans import vocabulary
from catalpa.session import table


def choose(place: str, values: tuple[str, ...]) -> str:
    """The value at a place, from 0, modulo the number of values."""
    quoted = ["'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE ({place}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


def text(number: str) -> str:
    return f"CAST({number} AS STRING)"


TYPES = ("smallint", "int4", "bigint", "real", "float8", "text", "varchar(20)", "character varying(50)", "numeric(10,2)", "numeric(8,2)", "bool", "decimal", "numeric(12)", "timestamp", "serial", "numeric")
LINES = "(SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, max(l_suppkey) AS u FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS x"
PLACE = f"'s' || {text('k % 3')} AS sch, 't' || {text('k')} AS tbl"
OBJECTS = f"""(SELECT sch, kind, tbl, name, min(c) AS c FROM (
    SELECT sch, kind, tbl, c, CASE kind WHEN 'comment' THEN CASE WHEN c % 2 = 0 THEN '' ELSE 'c' || {text('c % 5')} END WHEN 'check' THEN CASE c % 6 WHEN 0 THEN tbl || '_check' WHEN 1 THEN tbl || '_c1_check' || {text('k')} WHEN 2 THEN tbl || 'x_check' WHEN 3 THEN tbl || '_zz_check2'
        WHEN 4 THEN tbl || '_c1' ELSE 'ck_' || {text('k')} END ELSE kind || '_' || {text('k')} END AS name
    FROM (SELECT o_orderkey AS k, o_custkey AS c, 's' || {text('(o_orderkey - o_orderkey % 40) % 3')} AS sch, {choose('o_orderkey', ('index', 'fk', 'check', 'trigger', 'comment', 'sequence'))} AS kind, CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE 't' || {text('o_orderkey - o_orderkey % 40')} END AS tbl FROM {{orders}}) AS o) AS named
    GROUP BY sch, kind, tbl, name) AS x"""
PARTS = "(SELECT p_partkey AS p, p_size AS z FROM {part}) AS x"
PEOPLE = "(SELECT c_custkey AS c, c_nationkey AS a FROM {customer}) AS x"
ORDERS = "(SELECT o_orderkey AS k, o_custkey AS c FROM {orders}) AS x"
PRIVILEGES = ("SELECT", "SELECT,INSERT", "UPDATE", "ALL", "DELETE,SELECT", "USAGE")

SQL = {
    "live_columns": f"""SELECT {PLACE}, 'c' || {text('n')} AS col, {choose('p', TYPES)} AS data_type, p % 2 = 0 AS nullable,
        {choose('p', ("", "0", "(0)", "'x'::text", "TRUE", "now()"))} AS dflt, CASE WHEN p % 13 = 0 THEN 'c1 * 2' ELSE '' END AS generated FROM {LINES} WHERE u % 10 <> 1 AND k % 23 <> 0""",
    "desired_columns": f"""SELECT {PLACE}, CASE WHEN u % 10 = 2 THEN 'r' ELSE 'c' END || {text('n')} AS col, {choose('p + CASE WHEN u % 3 = 0 THEN 1 + k % 5 ELSE 0 END', TYPES)} AS data_type, (p % 2 = 0) <> (u % 9 = 0) AS nullable,
        {choose('p + CASE WHEN u % 11 = 0 THEN 1 ELSE 0 END', ("", "(0)", "0", "'x'", "true", "CURRENT_TIMESTAMP"))} AS dflt, CASE WHEN p % 13 = 0 THEN CASE WHEN u % 2 = 0 THEN 'c1 * 3' ELSE 'c1 * 2' END ELSE '' END AS generated FROM {LINES} WHERE k % 29 <> 0""",
    "renames": f"SELECT 't' || {text('k')} || '.c' || {text('n')} AS old_name, 'r' || {text('n')} AS new_name FROM {LINES} WHERE u % 20 = 2 UNION ALL SELECT * FROM (VALUES ('c3', 'r3'), ('c3', 'r5'), ('c4', 'r3'), ('c2', 'r1')) AS loose(old_name, new_name)",
    "live_objects": f"SELECT sch, kind, tbl, name, CASE WHEN kind = 'comment' THEN {choose('c', ('', 'x', 'y'))} ELSE 'd' || {text('c % 4')} END AS definition, c % 7 <> 0 AS valid FROM {OBJECTS} WHERE c % 10 <> 1",
    "desired_objects": f"""SELECT sch, kind, tbl, name, CASE WHEN kind = 'comment' THEN {choose('c + c % 2', ('', 'x', 'y'))} ELSE 'd' || {text('(c + CASE WHEN c % 3 = 0 THEN 1 ELSE 0 END) % 4')} || CASE WHEN kind IN ('fk', 'check') AND c % 8 = 0 THEN ' NOT VALID' ELSE '' END END AS definition,
        true AS valid FROM {OBJECTS} WHERE c % 10 <> 2""",
    "live_enums": f"SELECT 's' || {text('p % 2')} AS sch, 'e' || {text('p % 97')} AS name, 'v' || {text('p')} AS label, CAST(p AS INT) AS pos FROM {PARTS} WHERE p % 7 <> 1 AND p % 97 <> 5",
    "desired_enums": f"SELECT 's' || {text('p % 2')} AS sch, 'e' || {text('p % 97')} AS name, CASE WHEN p % 7 = 3 THEN 'w' ELSE 'v' END || {text('p')} AS label, CAST(p AS INT) AS pos FROM {PARTS} WHERE p % 7 <> 2 AND p % 97 <> 6",
    "enum_renames": f"SELECT 'enum.e' || {text('p % 97')} || '.v' || {text('p')} AS old_name, 'w' || {text('p')} AS new_name FROM {PARTS} WHERE p % 21 = 3 UNION ALL SELECT 'e' || {text('p % 97')} || '.v' || {text('p')}, 'w' || {text('p')} FROM {PARTS} WHERE p % 21 = 10 UNION ALL SELECT 'e' || {text('p % 97')} || '.v' || {text('p + 388')}, 'w' || {text('p')} FROM {PARTS} WHERE p % 21 = 3",
    "live_views": f"SELECT 's' || {text('c % 2')} AS sch, 'v' || {text('c - c % 2')} AS name, CASE WHEN c % 19 > 0 THEN 'q' || {text('a % 5')} END AS definition, c % 5 = 0 AS materialised, {{split}}({choose('c', ('a,b', 'a', 'b,c,d', 'a,b,c'))}, ',') AS cols FROM {PEOPLE} WHERE a % 10 <> 1",
    "desired_views": f"SELECT 's' || {text('c % 2')} AS sch, 'v' || {text('c - c % 2')} AS name, CASE WHEN c % 19 > 0 THEN 'q' || {text('(a + CASE WHEN c % 3 = 0 THEN 1 ELSE 0 END) % 5')} END AS definition, c % 5 = 0 AND c % 4 <> 1 AS materialised, {{split}}({choose('c + CASE WHEN a % 4 = 0 THEN 3 ELSE 0 END', ('a,b', 'a', 'b,c,d', 'a,b,c'))}, ',') AS cols FROM {PEOPLE} WHERE a % 10 <> 2",
    "live_policies": f"SELECT 's' || {text('c % 3')} AS sch, 't' || {text('(c - c % 3) % 50')} AS tbl, 'p' || {text('c - c % 3')} AS name, {choose('c', ('SELECT', 'ALL', 'UPDATE'))} AS cmd, c % 4 <> 0 AS permissive, {{split}}({choose('a', ('public', 'app', 'App ,web', 'web,app'))}, ',') AS roles, {choose('a', ('true', 'id = 1', ''))} AS using_expr, {choose('a + c', ('', 'id > 0'))} AS check_expr FROM {PEOPLE} WHERE a % 10 <> 1",
    "desired_policies": f"SELECT 's' || {text('c % 3')} AS sch, 't' || {text('(c - c % 3) % 50')} AS tbl, 'p' || {text('c - c % 3')} AS name, {choose('c + CASE WHEN c % 11 = 0 THEN 1 ELSE 0 END', ('SELECT', 'ALL', 'UPDATE'))} AS cmd, (c % 4 <> 0) <> (c % 17 = 0) AS permissive, {{split}}({choose('a', ('PUBLIC', 'app', 'web,app', 'WEB, app'))}, ',') AS roles, {choose('a + CASE WHEN c % 3 = 0 THEN 1 ELSE 0 END', ('true', 'id = 1', ''))} AS using_expr, {choose('a + c', ('', 'id > 0'))} AS check_expr FROM {PEOPLE} WHERE a % 10 <> 2",
    "live_grants": f"SELECT 's' || {text('c % 2')} AS sch, {choose('k', ('table', 'sequence', 'schema'))} AS kind, 'o' || {text('k - k % 9')} AS obj, {choose('c', ('app', 'web', 'PUBLIC', 'report'))} AS grantee, {choose('c + k', PRIVILEGES)} AS privileges, c % 9 = 0 AS grantable FROM {ORDERS} WHERE c % 10 <> 1",
    "desired_grants": f"SELECT 's' || {text('c % 2')} AS sch, {choose('k', ('table', 'sequence', 'schema'))} AS kind, 'o' || {text('k - k % 9')} AS obj, {choose('c', ('app', 'web', 'PUBLIC', 'report'))} AS grantee, {choose('c + k + k % 2', PRIVILEGES)} AS privileges, c % 8 = 0 AS grantable FROM {ORDERS} WHERE c % 10 <> 2",
    "live_tables": f"SELECT 's' || {text('c % 3')} AS sch, 't' || {text('c')} AS tbl, c % 4 = 0 AS rls, c % 6 = 0 AS forced, CASE WHEN c % 10 = 0 THEN 'RANGE' ELSE '' END AS strategy, CASE WHEN c % 10 = 0 THEN 'c1,c2' ELSE '' END AS part_cols, CASE WHEN c % 10 IN (1, 2, 3) THEN 't' || {text('c - c % 10')} ELSE '' END AS parent, CASE WHEN c % 10 = 3 THEN 'DEFAULT' WHEN c % 10 IN (1, 2) THEN 'FROM ' || {text('a')} ELSE '' END AS bounds, c % 14 = 0 AS pending FROM {PEOPLE} WHERE a <> 1",
    "desired_tables": f"SELECT 's' || {text('c % 3')} AS sch, 't' || {text('c')} AS tbl, (c % 4 = 0) <> (a % 5 = 0) AS rls, (c % 6 = 0) <> (a % 7 = 0) AS forced, CASE WHEN c % 10 = 0 AND a % 6 <> 0 THEN CASE WHEN a % 6 = 1 THEN 'LIST' ELSE 'RANGE' END ELSE '' END AS strategy, CASE WHEN c % 10 = 0 AND a % 6 <> 0 THEN CASE WHEN a % 6 = 2 THEN 'c2' ELSE 'c1,c2' END ELSE '' END AS part_cols, CASE WHEN c % 10 IN (2, 3, 4) THEN 't' || {text('c - c % 10')} ELSE '' END AS parent, CASE WHEN c % 10 = 3 THEN 'DEFAULT' WHEN c % 10 IN (2, 4) THEN 'FROM ' || {text('a + CASE WHEN c % 3 = 0 THEN 1 ELSE 0 END')} ELSE '' END AS bounds, false AS pending FROM {PEOPLE} WHERE a <> 2",
    "unique_sets": f"SELECT 's' || {text('c % 3')} AS sch, 't' || {text('c')} AS tbl, {choose('a', ('pk', 'ux'))} AS name, {choose('a + c', ('c1', 'c1,c2', 'c2,c1,c3', ''))} AS cols FROM {PEOPLE} WHERE a % 3 <> 0",
    "live_routines": f"SELECT 's' || {text('p % 3')} AS sch, 'f' || {text('p % 331')} AS name, {choose('p', ('integer, text', 'int4,  bool', '', 'bigint'))} || CASE WHEN p < 331 THEN '' ELSE ', numeric(' || {text('p')} || ')' END AS args, {choose('p', ('int', 'text', 'void'))} AS returns, {choose('z', ('FUNCTION', 'PROCEDURE', 'AGGREGATE'))} AS kind, {choose('p', ('sql', 'plpgsql'))} AS language, 'body ' || {text('z % 7')} AS definition FROM {PARTS} WHERE z % 10 <> 1",
    "desired_routines": f"SELECT 's' || {text('p % 3')} AS sch, 'f' || {text('p % 331')} AS name, {choose('p', ('int4, text', 'integer, boolean', '', 'int8'))} || CASE WHEN p < 331 THEN '' ELSE ', numeric(' || {text('p')} || ')' END AS args, {choose('p + CASE WHEN z % 9 = 0 THEN 1 ELSE 0 END', ('integer', 'text', 'void'))} AS returns, {choose('z', ('FUNCTION', 'PROCEDURE', 'AGGREGATE'))} AS kind, {choose('p + CASE WHEN z % 13 = 0 THEN 1 ELSE 0 END', ('sql', 'plpgsql'))} AS language, 'body ' || {text('(z + CASE WHEN p % 4 = 0 THEN 1 ELSE 0 END) % 7')} AS definition FROM {PARTS} WHERE z % 10 <> 2",
    "live_domains": f"SELECT 'd' || {text('p')} AS name, {choose('p', TYPES)} AS base, p % 2 = 0 AS nullable, {choose('z', ('', '0'))} AS dflt, {choose('z', ('ck1', 'ck2', ''))} AS check_name, 'VALUE > ' || {text('z % 5')} AS check_expr FROM {PARTS} WHERE z % 10 <> 1",
    "desired_domains": f"SELECT 'd' || {text('p')} AS name, {choose('p + CASE WHEN z % 6 = 0 THEN 1 ELSE 0 END', TYPES)} AS base, (p % 2 = 0) <> (z % 11 = 0) AS nullable, {choose('z', ('', '0'))} AS dflt, {choose('z + CASE WHEN p % 5 = 0 THEN 1 ELSE 0 END', ('ck1', 'ck2', ''))} AS check_name, 'VALUE > ' || {text('(z + CASE WHEN p % 7 = 0 THEN 1 ELSE 0 END) % 5')} AS check_expr FROM {PARTS} WHERE z % 10 <> 2",
    "live_types": f"SELECT CASE WHEN p % 5 = 0 THEN 'range' ELSE 'composite' END AS kind, CASE WHEN p % 5 = 0 THEN 'r' || {text('p')} ELSE 'k' || {text('p % 211')} END AS name, CASE WHEN p % 5 = 0 THEN '' ELSE 'a' || {text('p')} END AS attr, {choose('p', TYPES)} AS data_type FROM {PARTS} WHERE z % 10 <> 1 AND p % 211 <> 7",
    "desired_types": f"SELECT CASE WHEN p % 5 = 0 THEN 'range' ELSE 'composite' END AS kind, CASE WHEN p % 5 = 0 THEN 'r' || {text('p')} ELSE 'k' || {text('p % 211')} END AS name, CASE WHEN p % 5 = 0 THEN '' ELSE 'a' || {text('p')} END AS attr, {choose('p + CASE WHEN z % 6 = 0 THEN 1 ELSE 0 END', TYPES)} AS data_type FROM {PARTS} WHERE z % 10 <> 2 AND p % 211 <> 9",
    "live_extensions": f"SELECT 'ext' || {text('a')} AS name FROM {PEOPLE} WHERE c % 2 = 0 AND a % 3 <> 1 GROUP BY a",
    "desired_extensions": f"SELECT 'ext' || {text('a')} AS name, max(CASE WHEN a % 4 = 0 THEN '1.' || {text('a')} ELSE '' END) AS version FROM {PEOPLE} WHERE a % 5 <> 2 GROUP BY a",
    "replication": f"SELECT {choose('c', ('publication', 'event_trigger', 'subscription', 'replication_slot'))} AS kind, 'n' || {text('c')} AS name, 'q' || {text('a % 3')} AS definition, {choose('a', ('t1,t2', 't2,t1', 't1', ''))} AS members, c % 3 <> 0 AS stamped, c % 5 = 0 AS active, c % 7 = 0 AS asked, a % 10 <> 1 AS is_live, a % 10 <> 2 AS is_desired, {choose('a + CASE WHEN c % 3 = 1 THEN 1 ELSE 0 END', ('t2,t1', 't1,t2', 't1', ''))} AS new_members, 'q' || {text('(a + CASE WHEN c % 4 = 1 THEN 1 ELSE 0 END) % 3')} AS new_definition FROM {PEOPLE}",
    "sequences": f"SELECT 's' || {text('k % 3')} AS sch, 't' || {text('k')} || '_c1_seq' AS name, 't' || {text('k')} AS owner_tbl, 'c1' AS owner_col FROM {ORDERS}",
    "defaults": f"SELECT 's' || {text('k % 3')} AS sch, 't' || {text('k')} AS tbl, 'c1' AS col, CASE WHEN c % 2 = 0 THEN 'nextval(''t' || {text('k')} || '_c1_seq''::regclass)' ELSE '0' END AS dflt FROM {ORDERS}",
    "protected": f"SELECT {choose('c', ('trigger', 'function', 'view'))} AS kind, 'u' || {text('c % 700')} AS obj, 't' || {text('k - k % 20')} AS tbl, CASE WHEN k % 3 = 0 THEN '' ELSE 'c' || {text('k % 4')} END AS col FROM {ORDERS}",
    "dropped": f"SELECT 't' || {text('k - k % 20')} AS tbl, CASE WHEN c % 5 = 0 THEN '' ELSE 'c' || {text('c % 4')} END AS col FROM {ORDERS} GROUP BY k - k % 20, CASE WHEN c % 5 = 0 THEN '' ELSE 'c' || {text('c % 4')} END",
    "triggers": f"""SELECT 't' || {text('k - k % 50')} AS tbl, 'tr' || {text('k')} AS name, 'CREATE TRIGGER tr EXECUTE ' || CASE WHEN k % 2 = 0 THEN 'FUNCTION ' ELSE 'procedure ' END || CASE k % 4 WHEN 0 THEN 'f' || {text('c % 331')} WHEN 1 THEN 'public.F' || {text('c % 331')} WHEN 2 THEN '"s.x"."F' || {text('c % 331')} || '"' ELSE 's0."f' || {text('c % 331')} || '"' END || '()' AS definition FROM {ORDERS}""",
    "view_bodies": f"SELECT 'v' || {text('c')} AS name, 'SELECT f' || {text('a * 13')} || '(x), xf' || {text('c % 331')} || '(y) FROM t WHERE F' || {text('c % 7')} || '(z) > 0' AS definition FROM {PEOPLE}",
    "steps": f"""SELECT c - c % 4 AS plan_id, k AS idx, {choose('k', vocabulary.CHANGE_TYPES)} AS change_type, 's' || {text('c % 2')} AS sch, 't' || {text('c % 97')} AS tbl, CASE WHEN c % 11 = 0 THEN 't' || {text('c % 5')} ELSE '' END AS parent, c % 3 = 0 AS destructive, k % 5 = 0 AS non_tx, c % 2 = 0 AS narrowed, c % 9 = 0 AS generated, k % 2 = 0 AS not_null, CASE WHEN c % 4 = 0 THEN '0' ELSE '' END AS dflt, c % 13 = 0 AS unmanaged,
        c % 2 = 1 AS candidate, c % 5 = 0 AS rebuild, c % 2 = 0 AS pending, c % 3 <> 0 AS validates_check, CASE WHEN c % 4 = 1 THEN 'old words' ELSE '' END AS old_comment,
        {choose('c', ('plain', 'create function f Security Definer', 'create function f SECURITY DEFINER set search_path = a', 'grant select on t to Public', 'alter role r password ''x''', 'create publication p for all tables', 'alter publication p SET ALL TABLES'))} || ' ' || {text('k')} AS sql_text FROM {ORDERS}""",
    "tables_needing": f"SELECT k - k % 40 AS plan_id, 's' || {text('k % 2')} AS sch, 't' || {text('k')} AS tbl, {choose('c', ('CREATE_TABLE', 'DROP_TABLE'))} AS change_type, CASE WHEN k % 9 = 0 THEN '' ELSE 's' || {text('(k + 1) % 2')} || '.t' || {text('k + 1 - 8 * (k % 2) + (c % 3)')} END AS needs FROM {ORDERS}",
    "roles": f"SELECT k AS seq, 'role' || {text('c % 60')} AS role, {choose('k + c', ('CREATE', 'ALTER', 'ALTER', 'DROP', 'CREATE'))} AS op, CASE WHEN k % 3 = 0 THEN 'login' ELSE '' END AS attrs, CASE WHEN k % 4 = 0 THEN 'note ' || {text('k')} ELSE '' END AS remark FROM {ORDERS}",
    "live_sequences": f"SELECT 'q' || {text('p')} AS name, {choose('p', ('', 'int4', 'smallint', 'bigint', 'integer'))} AS data_type, CASE z % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 2 ELSE 0 END AS step, CASE WHEN z % 5 = 0 THEN CAST(z AS BIGINT) END AS low, CASE WHEN p % 6 = 0 THEN CAST(32767 AS BIGINT) END AS high, CAST(z % 3 AS BIGINT) AS cache, p % 9 = 0 AS cycle, CASE WHEN p % 4 = 0 THEN 't1' ELSE '' END AS owner_tbl, CASE WHEN p % 4 = 0 THEN 'c1' ELSE '' END AS owner_col, p % 12 = 0 AS implicit, p % 19 = 0 AS unmanaged FROM {PARTS} WHERE z % 10 <> 1",
    "desired_sequences": f"SELECT 'q' || {text('p')} AS name, {choose('p', ('bigint', 'integer', 'smallint', '', 'serial'))} AS data_type, CASE z % 4 WHEN 0 THEN CASE WHEN p % 7 = 0 THEN 3 ELSE 0 END WHEN 1 THEN -1 WHEN 2 THEN 2 ELSE 1 END AS step, CASE WHEN z % 5 = 0 THEN CAST(z AS BIGINT) WHEN z % 4 = 0 THEN CAST(1 AS BIGINT) END AS low, CASE WHEN p % 6 = 0 AND p % 5 <> 2 THEN CAST(32767 AS BIGINT) END AS high, CAST(CASE WHEN z % 3 = 0 THEN 1 ELSE z % 3 END AS BIGINT) AS cache, (p % 9 = 0) <> (p % 31 = 0) AS cycle, CASE WHEN p % 4 = 0 THEN 't1' ELSE '' END AS owner_tbl, CASE WHEN p % 4 = 0 THEN CASE WHEN z % 6 = 0 THEN 'c2' ELSE 'c1' END ELSE '' END AS owner_col, p % 12 = 0 AS implicit, false AS unmanaged FROM {PARTS} WHERE z % 10 <> 2",
    "constraints": f"SELECT c AS rel, 'pk_' || {text('c')} AS name, {choose('c', ('1', '2,1', '3,1,2', '9'))} AS places FROM {PEOPLE}",
    "attributes": f"SELECT c AS rel, 1 AS place, 'id_' || {text('c')} AS col FROM {PEOPLE} UNION ALL SELECT c, 2, 'b' FROM {PEOPLE} WHERE a % 7 <> 0 UNION ALL SELECT c, 3, 'c' FROM {PEOPLE}",
    "view_links": f"SELECT 'v' || {text('c')} AS view_name, {choose('a', ('table', 'routine'))} AS kind, 't' || {text('a')} AS needs FROM {PEOPLE} UNION ALL SELECT 'v' || {text('c % 100')}, 'table', 't' || {text('a')} FROM {PEOPLE}",
    "acls": f"SELECT {choose('c', ('table', 'sequence', 'schema', 'function'))} AS kind, 'o' || {text('c')} AS obj, {choose('a', ('7=rw*;0=r', '3=U', '', '9=arwdDxt;3=r*'))} AS acl FROM {PEOPLE}",
    "role_ids": f"SELECT DISTINCT a AS id, 'role' || {text('a')} AS role, {choose('a', ('work_mem=4MB,search_path=app', '', 'timezone=UTC'))} AS settings FROM {PEOPLE} WHERE a <> 9",
    "open_work": f"SELECT 's' || {text('c % 60')} AS schema_name, k AS step FROM {ORDERS} WHERE c % 60 < 40",
    "lint_tables": f"SELECT 't' || {text('c')} || CASE WHEN a % 8 = 0 THEN 'X' ELSE '' END AS tbl, {choose('a', ('', 'words'))} AS comment, c % 5 = 0 AS rls, c % 9 = 0 AS partition, CAST(a % 3 AS INT) AS policies FROM {PEOPLE} UNION ALL SELECT 'all', 'x', false, false, 0 FROM {PEOPLE} WHERE c = 1 UNION ALL SELECT 'order', '', true, false, 0 FROM {PEOPLE} WHERE c = 1",
    "lint_columns": f"""SELECT 't' || {text('k')} AS tbl, CASE WHEN p % 19 = 0 THEN {choose('u', ('Limit', 'all', 'user', 'value', 'key'))} ELSE {choose('p', ('id', 'net_price', 'is_active', 'Total', 'org_id', 'note', 'cost'))} || '_' || {text('n')} END AS col, {choose('u', ('bigint', 'real', 'Boolean', 'double precision', 'text', 'float(8)', 'bool', 'uuid', 'bigserial'))} AS data_type,
        {choose('p', ('', 'false', "nextval('s'::regclass)", ' '))} AS dflt, p % 6 = 0 AS identity FROM {LINES}""",
    "lint_keys": f"SELECT 't' || {text('k')} AS tbl, {{split}}(min(CASE WHEN p % 2 = 0 THEN 'id_' || {text('n')} ELSE 'id_' || {text('n')} || ',note_' || {text('n')} END), ',') AS cols FROM {LINES} WHERE k % 6 <> 0 GROUP BY k",
    "lint_indexes": f"SELECT 't' || {text('k - k % 10')} AS tbl, {choose('c', ('ix_', 'IX_'))} || {text('k')} AS name, {{split}}({choose('c', ('id_1', 'id_1,note_2', 'is_active_3,id_2', 'a,b,c,d,e', 'org_id_1', 'deleted,id_1', 'org_id_1,id_1', 'note_1'))}, ',') AS cols, c % 3 = 0 AS is_unique, {choose('c', ('', '', 'note_1 > 0'))} AS predicate FROM {ORDERS}",
    "lint_fks": f"SELECT 't' || {text('k - k % 10')} AS tbl, 'fk_' || {text('k')} AS name, {{split}}({choose('c', ('org_id_1', 'id_1,org_id_1', 'tenant_id', 'note_9', 'id_2,is_active_3'))}, ',') AS cols, {choose('k', ('', 'cascade', 'CASCADE'))} AS on_delete FROM {ORDERS}",
    "lint_checks": f"""SELECT 't' || {text('k - k % 10')} AS tbl, CASE k % 4 WHEN 0 THEN 't' || {text('k - k % 10')} || '_check' || {text('k')} WHEN 1 THEN 't' || {text('k - k % 10')} || '_id_1_check' ELSE {choose('c', ('Ck_', 'ck_'))} || {text('k')} END AS name,
        {choose('c', ('CHECK ((a > 0))', '(A>0)', 'a > 0', "name <> 'X y'", "NAME<>'X y'", "name <> 'x y'", '(a > 0) AND (b > 0)', ''))} AS expr FROM {ORDERS}""",
    "lint_triggers": f"SELECT 't' || {text('k - k % 10')} AS tbl, 'tr_' || {text('k')} AS name, 'fn' || {text('c % 40')} AS fn FROM {ORDERS}",
    "lint_routines": f"SELECT DISTINCT 'fn' || {text('c % 33')} AS fn FROM {ORDERS}",
    "lint_enums": f"SELECT DISTINCT {choose('p', ('mood_', 'Mood'))} || {text('p % 50')} AS name FROM {PARTS}",
    "lint_extensions": f"SELECT CASE WHEN a % 2 = 0 THEN 'Ext' ELSE 'ext' END || {text('c % 30')} AS name, max({choose('c % 30', ('', ' ', '1.2'))}) AS version FROM {PEOPLE} GROUP BY a % 2, c % 30",
}

USED = re.compile(r"\{(lineitem|orders|part|customer|events)\}")


@contextmanager
def kept_lines(spark: SparkSession, sf_dir: str) -> Iterator[str]:
    """A view of the grouped line items that several snapshots are derived from, grouped once and kept until all that reads them is checkpointed."""
    view = f"lines_{uuid.uuid4().hex}"
    spark.sql(f"SELECT * FROM {LINES}", lineitem=table(spark, sf_dir, "lineitem")).persist().createOrReplaceTempView(view)
    try:
        yield view
    finally:
        spark.catalog.dropTempView(view)  # what is kept goes with it


def frame(spark: SparkSession, sf_dir: str, name: str, lines: str | None = None) -> DataFrame:
    """A derived snapshot as a DataFrame, from a view of kept lines if one is named."""
    text = SQL[name].replace(LINES, f"{lines} AS x") if lines else SQL[name]
    tables = {t: table(spark, sf_dir, t) for t in set(USED.findall(text))}
    return spark.sql(text.replace("{split}", "split"), **tables)


def frames(spark: SparkSession, sf_dir: str, *names: str, lines: str | None = None) -> list[DataFrame]:
    return [frame(spark, sf_dir, name, lines) for name in names]


def twin(sql: str, **names: str) -> str:
    """DuckDB SQL with the derived snapshots under short names in front of it."""
    parts = [f"{short} AS ({USED.sub(lambda m: m[1], SQL[name]).replace('{split}', 'string_split')})" for short, name in names.items()]
    recursive = "RECURSIVE " if sql.lstrip().startswith("/* recursive */") else ""
    return f"WITH {recursive}" + ", ".join(parts) + sql
