"""Every registered query of the operators: over tables with odd rows, and against its SQL where it has some."""

import os
import zlib
from collections import Counter
from decimal import Decimal

import duckdb
import pytest
from llm.conftest import LONG
from llm.test_string_kernel import corpus
from pyspark.sql import functions as F

import corpus_pipeline
from catalpa.llm import queries, sql_parts

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BIG = 2**60 + 1
IDS = [BIG, None, 2**60 + 3, None, 7, 7, 40, -20, 2**60 + 4]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Tables with ids beyond 2**53 beside nulls, repeated rows, and null, empty and long texts; one file each, so that they share a batch."""
    folder = tmp_path_factory.mktemp("odd")
    *rows, fresh = corpus(61)
    rows += [(i, t, "en", "a") for i, t in zip(IDS, [fresh[1], rows[3][1], None, "", LONG, "mail x@y.org or 1.2.3.4", "one", "!", rows[6][1]])]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], i % 4 // 3, 1) for i, r in enumerate(rows)], "doc_id long, toxic int, quality int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, f"http://a{k % 3}.example.com/en/{k}") for k, i in enumerate([*IDS, *range(20)])], "page_id long, url string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    vectors = [(i, [0.1 * k, 1.0 - k, *[0.5] * 62], k % 3) for k, i in enumerate([*IDS, *range(20)])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(BIG, rows[6][1]), (None, "mail x"), (3, None)], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def held(i, mod):
    return zlib.crc32(str("" if i is None else i).encode()) % mod


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n.startswith("op")))
def test_ids_survive(spark, odd_dir, name):
    rows = queries.QUERIES[name](spark, odd_dir).collect()
    table, key = {"op4_inner_product": ("embeddings", "query_id"), "op10_url_filter": ("pages", "page_id"), "op12_centroids": ("embeddings", "vec_id"), "op13_hard_negatives": ("embeddings", "anchor_id")}.get(name, ("documents", "doc_id"))
    given = [r[0] for r in spark.read.parquet(f"{odd_dir}/{table}.parquet").select("vec_id" if table == "embeddings" else key).collect()]
    if name == "op4_inner_product":
        assert {r["query_id"] for r in rows} == {i for i in given if i is not None and i % 20 == 0} and {r["vec_id"] for r in rows} <= set(given)
        return
    if name == "op13_hard_negatives":
        assert {r["anchor_id"] for r in rows} <= {i for i in given if i is not None and i % 50 == 0} and {r[c] for r in rows for c in ("positive_id", "negative_id")} <= set(given) - {None}
        return
    assert Counter(r[key] for r in rows) == Counter(given)
    first = rows[0].asDict()
    if name == "op1_toxicity":
        assert all(r["held_out"] == (held(r["doc_id"], 3) == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    if name == "op2_language_id":
        assert all(r["held_out"] == (held(r["doc_id"], 5) == 0) and isinstance(r["lang_pred"], str) for r in rows)
    if name == "op9_lattice_lm":
        assert all(r["held_out"] == (held(r["doc_id"], 10) == 0) and r["n_known"] <= r["n_tokens"] for r in rows) and len({r["train_tokens"] for r in rows}) == 1
    if name == "op11_decontamination":
        assert {r["n_items"] for r in rows if r["contaminated"]} == {1} and all((r["n_hit"] > 0) == r["contaminated"] for r in rows)
    if name == "op12_centroids":
        assert len({r["cluster"] for r in rows}) <= 40 and len({r["inertia"] for r in rows}) == 1
    if name == "op5_mixing":
        assert list(first) == ["doc_id", "size", "source_size", "target", "taken"]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_leave_other_columns_alone(spark, odd_dir, name, stage):
    """Longs beside nulls, decimals, times and nested values pass unchanged, under names that stages could use themselves."""
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    big = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.lit(BIG)).cast("long")
    docs = docs.withColumns({"often": big, "gone": F.lit(Decimal("1.10")), "__size": F.array(F.lit(1), F.lit(None).cast("int")), "Score": F.lit("kept"), "lang_pred": F.timestamp_seconds(F.lit(7)), "h": F.struct(F.lit(1).alias("x")), "i": F.lit(1), "key": F.map_from_arrays(F.array(F.lit("a")), F.array(F.lit(2))), "turn": F.lit(None).cast("string")})
    out = stage(spark, docs, odd_dir)
    kept = [c for c in docs.columns if name != "encode" or c != "text"]
    assert out.columns[: len(kept)] == kept and [out.schema[c].dataType for c in kept] == [docs.schema[c].dataType for c in kept]
    wide = {r["doc_id"]: r for r in out.collect()}
    assert wide[BIG]["often"] == BIG and wide[BIG]["gone"] == Decimal("1.10") and wide[BIG]["__size"] == [1, None] and wide[BIG]["key"] == {"a": 2}
    assert all((r["often"] is None) == (r["doc_id"] is None) and r["Score"] == "kept" for r in wide.values())


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns and len(got) == len(want)
    plain = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


def test_parts_are_registered():
    assert set(sql_parts.QUERIES) == set(sql_parts.ORACLES) and set(queries.ORACLES) <= set(queries.QUERIES)
