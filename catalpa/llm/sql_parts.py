"""The parts of the operators' answers that SQL can say, as queries of their own with DuckDB SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalpa.llm import lattice_lm, merkle, mixing, private_data, url_filter
from catalpa.llm.common import remainder
from catalpa.session import table


def base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3_private_data says of base spans."""
    found = private_data.base_only(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return private_data.digest(found).drop("spans")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5_mixing aims at, by document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sizes = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    goals = mixing.targets(sizes.groupBy("source", "size").agg(F.count("*").alias("n"))).withColumnRenamed("source", "s")
    return sizes.join(goals, F.expr("source <=> s")).select("doc_id", "size", "source_size", "target")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts that op6_merkle compares, by their digests."""
    return merkle.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_chars", "edited_sha256")


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base score beside op9_lattice_lm's score."""
    scored = lattice_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 10) != 0, base_only=True)
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of each url, with the verdict where a rule gives it."""
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


QUERIES = {f.__name__: f for f in (base_spans, mixing_targets, edited_texts, base_scores, url_rules)}

#: The base patterns as the contract writes them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({DIGITS}[-i] AS INTEGER) ELSE (2 * CAST({DIGITS}[-i] AS INTEGER)) // 10 + (2 * CAST({DIGITS}[-i] AS INTEGER)) % 10 END)) % 10 = 0"
PASSES = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR TRY_CAST(p AS INTEGER) > 255)) = 0",
    "card": f"length({DIGITS}) BETWEEN 16 AND 19 AND CASE WHEN length({DIGITS}) BETWEEN 16 AND 19 THEN {LUHN} END",
    "phone": f"length({DIGITS}) BETWEEN 8 AND 15",
}
FOUND = " UNION ALL ".join(
    f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, gaps[i] AS gap, hits[i] AS m, i FROM (
        SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d), range(1, len(hits) + 1) AS r(i)"""
    for place, (kind, pattern) in enumerate(PLAIN.items())
)
KEPT = " UNION ALL ".join(f"SELECT * FROM located WHERE kind = '{kind}' AND {passes}" for kind, passes in PASSES.items())
BLANKS = r"[\x20\x09-\x0D]+"
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, _: xor(x // 2, 3988292384 * (x % 2)))), 4294967295)"
RULES = "(VALUES " + ", ".join(f"('{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{says}')" for rule, says in (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))) + ") AS r(rule, name, start, says)"

ORACLES = {
    "base_spans": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        found AS ({FOUND}),
        located AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(m) AS start FROM found),
        kept AS ({KEPT})
        SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in PLAIN)},
               sha256(coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(m) AS BIGINT), ',' ORDER BY place, start), '')) AS base_sha256
        FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id""",
    "mixing_targets": f"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
        full_ones AS (SELECT a.source, a.words, a.w, (SELECT sum(least(3.0 * b.words, 3.0 * a.words / a.w * b.w)) FROM s b) <= (SELECT sum(words) FROM s) * (1 + 1e-12) AS capped FROM s a),
        level AS (SELECT CAST((SELECT sum(words) FROM s) - coalesce(sum(3 * words) FILTER (WHERE capped), 0) AS DOUBLE) / sum(w) FILTER (WHERE NOT capped) AS level FROM full_ones)
        SELECT doc_id, CAST(size AS BIGINT) AS size, words AS source_size, CASE WHEN capped THEN CAST(3 * words AS DOUBLE) ELSE level * w END AS target
        FROM d JOIN full_ones f ON d.source IS NOT DISTINCT FROM f.source, level""",
    "edited_texts": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                          coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS after FROM documents)
        SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substring(t, 1, n - n // 3) || substring(after, 1, n // 3)) AS edited_sha256 FROM d""",
    "base_scores": f"""
        WITH d AS (SELECT doc_id, {CRC} % 10 = 0 AS held_out, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BLANKS}'), lambda x: x <> '') AS w FROM documents),
        t AS (SELECT doc_id, held_out, unnest(list_append(w, ' ')) AS token FROM d),
        c AS (SELECT token, count(*) FILTER (WHERE NOT held_out) AS c FROM t GROUP BY token),
        whole AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) FILTER (WHERE c > 0) AS v FROM c)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, any_value(n) AS train_tokens, round(sum(log10((c + 0.1) / (n + 0.1 * (v + 1)))), 4) AS base_score
        FROM t JOIN c USING (token), whole GROUP BY doc_id, held_out""",
    "url_rules": f"""
        WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
        u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)
        SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(says, length(rule)) AS verdict
        FROM u LEFT JOIN {RULES} ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY ALL""",
}
