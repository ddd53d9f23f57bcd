"""One query for each corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalpa.llm import centroids, decontamination, hard_negatives, inner_product, jaccard_join, lattice_lm, merkle, mixing, nbest, private_data, sql_parts, string_kernel, toxicity, url_filter
from catalpa.llm.common import remainder
from catalpa.session import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    learn = remainder("doc_id", 3) != 1
    model = toxicity.train(docs.where(learn), labels.where(learn))
    asked = docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "text")
    return toxicity.score(asked, model).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = string_kernel.train(docs.where(remainder("doc_id", 5) != 0), "doc_id", "text", "lang")
    asked = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "text")
    return string_kernel.predict(asked, model)


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.digest(private_data.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_product.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=85)


def op8_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.segment_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lattice_lm.score(docs, remainder("doc_id", 10) != 0)
    return scored.withColumn("held_out", ~F.col("learn")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontamination.digest(decontamination.decontaminate(docs, items))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, ends = centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=40, rounds=5, scale=256.0, width=64, salt="2:")
    return centroids.report(found, ends)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return hard_negatives.mine(vectors.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_private_data": op3_private_data,
    "op4_inner_product": op4_inner_product,
    "op5_mixing": op5_mixing,
    "op6_merkle": op6_merkle,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_nbest": op8_nbest,
    "op9_lattice_lm": op9_lattice_lm,
    "op10_url_filter": op10_url_filter,
    "op11_decontamination": op11_decontamination,
    "op12_centroids": op12_centroids,
    "op13_hard_negatives": op13_hard_negatives,
    **sql_parts.QUERIES,
}

SOUND = "len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"
WHOLE = "list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT))"
NEAREST = """(SELECT rid, min({'d': d, 'c': c}) AS m FROM (
            SELECT rid, c, CAST(list_sum(list_transform(list_zip(k.v, o.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM k, %s o) GROUP BY rid)"""
ROUND = """
        a{0} AS MATERIALIZED {1},
        c{2} AS MATERIALIZED (
            SELECT o.c, coalesce(n.v, o.v) AS v FROM c{0} o LEFT JOIN (
                SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM (
                    SELECT m.c AS c, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT m, unnest(v) AS x, unnest(range(1, 65)) AS place FROM a{0} JOIN k USING (rid)) GROUP BY ALL) GROUP BY c) n ON n.c = o.c),"""
ORACLES = {
    "op12_centroids": f"""
        WITH k AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, {WHOLE} AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND {SOUND}),
        c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS c, v FROM k ORDER BY c LIMIT 40),
        {"".join(ROUND.format(i, NEAREST % f"c{i}", i + 1) for i in range(5))}
        z AS MATERIALIZED {NEAREST % "c5"}
        SELECT vec_id, m.c AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c5.v, ',')) AS centroid_sha256
        FROM z JOIN k USING (rid) JOIN c5 ON c5.c = m.c""",
    "op13_hard_negatives": f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {WHOLE} AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND {SOUND}),
        s AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
        SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 3""",
    "op4_inner_product": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 20""",
    "op7_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g
            FROM w),
        e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS sizes, count(*) AS common
            FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM p WHERE 100 * common >= 85 * (sizes - common)),
        r AS (SELECT doc_id AS node, doc_id AS reach FROM s UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a)
        SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CAST(min(r.reach) AS BIGINT) AS component_id
        FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, s.g""",
    "op11_decontamination": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        n AS (SELECT item_id, w, least(len(w), 10) AS size FROM i WHERE len(w) > 0),
        x AS (SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM n)),
        g AS (SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS t
              FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM x))),
        h AS (SELECT DISTINCT doc_id, k, g.size, item_id FROM g JOIN x USING (size, t)),
        p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM h) GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)""",
    **sql_parts.ORACLES,
}
