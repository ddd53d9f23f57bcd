"""Names in bodies of text: which objects a view, routine or document speaks of, also by names of several words.

Names and bodies are cut into tokens: words, and every other sign for itself. A name is the hash of all its tokens; a body has such a hash at each place for each length that some name has;
equal hashes are joined, and a hit is proved by its tokens and by the signs before and after. So the work follows the bodies' length, not bodies times names, and
`app.order items`, `Brand#2` or a quoted name is found as a whole.

A mention is what `\\b<name>\\b` finds in any case of letters, a word being a run of ASCII letters, digits and underscores: next to an end that is a word no word goes on, next to an
end that is another sign there must be a word. With quotes, a name between two of the signs " ' ` counts as well.

Before places leave a body, those whose first token starts no name are dropped, where names start with FIRSTS different tokens at most. Names are broadcast only where they are small.

Defined cases: an empty or null name is in no body, a null body names nothing. Mentions may overlap, each counts. Rows that share an id are told together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalpa.session import checkpoint, small, table

FIRSTS = 1000
QUOTES = ('"', "'", "`")
WORD = r"^\w+$"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?s)\w+|."), F.lit(0))


def named(names: DataFrame) -> DataFrame:
    """(name, own, n, h) of the different names."""
    kept = names.where("name <> ''").select("name").distinct().withColumn("own", tokens(F.col("name")))
    return checkpoint(kept.select("name", "own", F.size("own").alias("n"), F.xxhash64(F.array_join("own", "")).alias("h")))


def mentions(bodies: DataFrame, names: DataFrame, id_cols: list[str], body_col: str, quotes: bool = False) -> DataFrame:
    """(ids, name, times, first): how often each name stands in a body, and the number of tokens before its first mention."""
    wanted = named(names)
    lengths = sorted(r["n"] for r in wanted.select("n").distinct().collect())  # as many as there are lengths of names
    firsts = [r["f"] for r in wanted.select(F.col("own")[0].alias("f")).distinct().limit(FIRSTS + 1).collect()]
    cut = bodies.select(*id_cols, tokens(F.col(body_col)).alias("own"))
    places = F.when(F.size("own") > 0, F.sequence(F.lit(0), F.size("own") - 1)).otherwise(F.array().cast("array<int>"))
    if len(firsts) <= FIRSTS:
        places = F.filter(places, lambda p: F.get("own", p).isin(firsts))
    around = F.transform("places", lambda p: F.struct(p.alias("place"), F.slice("own", F.greatest(p, F.lit(1)), F.lit(max(lengths, default=0) + 2)).alias("near")))
    # Kept before it is exploded: a condition on the places, pushed below the tokens, would cut a body anew for each of them.
    kept = checkpoint(cut.withColumn("places", places).select(*id_cols, around.alias("around")))
    at = kept.select(*id_cols, F.explode("around").alias("x")).select(*id_cols, "x.*")
    start = F.when(F.col("place") > 0, F.lit(2)).otherwise(F.lit(1))  # where in near the place is, from 1
    each = at.withColumn("start", start).withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"))).where("start + n - 1 <= size(near)")
    hashed = each.withColumn("h", F.xxhash64(F.array_join(F.slice("near", F.col("start"), F.col("n")), "")))
    names_side = small(wanted.select("name", F.col("own").alias("said"), F.col("n").alias("m"), F.col("h").alias("g")), 64 + 2 * F.length("name") + 16 * F.col("m"))
    met = hashed.join(names_side, F.expr("h = g AND n = m AND slice(near, start, n) = said"))
    before, after = F.when(F.col("start") == 2, F.col("near")[0]), F.get("near", F.col("start") + F.col("n") - 1)
    is_word = lambda t: F.coalesce(t.rlike(WORD), F.lit(False))
    borders = (is_word(F.col("said")[0]) != is_word(before)) & (is_word(F.element_at("said", -1)) != is_word(after))
    if quotes:
        borders = borders | F.coalesce(before.isin(*QUOTES) & after.isin(*QUOTES), F.lit(False))
    return met.where(borders).groupBy(*id_cols, "name").agg(F.count("*").alias("times"), F.min("place").alias("first"))


#: View bodies that name parts and brands: after a schema, in quotes, in capitals, and as the start of a longer word.
BODIES = """SELECT 'v' || {c} AS obj, 'SELECT * FROM app.' || p_name || ' AS a JOIN "' || upper(p_name) || '" ON a.x = ''' || p_brand || '''; -- ' || p_type || ' ' || p_name || CASE WHEN c % 3 = 0 THEN 's and ' ELSE ' and ' END || p_brand || '7' AS body
    FROM (SELECT c_custkey AS c FROM {customer}) AS v JOIN {part} ON p_partkey = c + 1"""
NAMES = "SELECT DISTINCT p_name AS name FROM {part} UNION SELECT DISTINCT p_brand FROM {part} UNION SELECT DISTINCT 'app.' || p_name FROM {part} UNION SELECT DISTINCT '\"' || p_name || '\"' FROM {part} UNION SELECT DISTINCT 'a JOIN' FROM {part}"


def view_mentions(spark, sf_dir: str) -> DataFrame:
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    bodies, names = spark.sql(BODIES.replace("{c}", "CAST(c AS STRING)"), part=part, customer=customer), spark.sql(NAMES, part=part)
    return mentions(bodies, names, ["obj"], "body").select("obj", "name", "times")


def document_mentions(spark, sf_dir: str) -> DataFrame:
    """Documents that hold the first words of a benchmark text, in any case of letters."""
    names = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", r"^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+", 0).alias("name"))
    found = mentions(table(spark, sf_dir, "documents").select("doc_id", "text"), names, ["doc_id"], "text")
    return found.groupBy("doc_id").agg(F.count("*").alias("names"), F.sum("times").alias("times"))


QUERIES = {f.__name__: f for f in (view_mentions, document_mentions)}

ORACLES = {
    "view_mentions": f"""
        WITH b AS ({BODIES.replace("{c}", "CAST(c AS VARCHAR)").replace("{customer}", "customer").replace("{part}", "part")}), n AS ({NAMES.replace("{part}", "part")})
        SELECT obj, name, CAST(len(regexp_extract_all(body, '(?i)\\b' || regexp_escape(name) || '\\b')) AS BIGINT) AS times
        FROM b JOIN n ON contains(lower(body), lower(name)) WHERE regexp_matches(body, '(?i)\\b' || regexp_escape(name) || '\\b')""",
    "document_mentions": """
        WITH n AS (SELECT DISTINCT regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+') AS name FROM benchmark),
        h AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b' || regexp_escape(name) || '\\b')) AS times FROM documents JOIN n ON name <> '' AND contains(lower(text), lower(name)))
        SELECT doc_id, count(*) AS names, CAST(sum(times) AS BIGINT) AS times FROM h WHERE times > 0 GROUP BY doc_id""",
}
