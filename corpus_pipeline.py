"""From raw documents to piece ids: language ID, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the columns of docs.
Extra columns of documents are kept, whatever their names and types. Empty tables pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalpa.llm import jaccard_join, mixing, nbest, private_data, string_kernel
from catalpa.llm.common import col, fresh, hashed
from catalpa.session import checkpoint, small, table

#: A text whose language isn't given is rejected if no language has this share of its scores: it is like none, or like all.
LEAST_LANGUAGE_SCORE = 0.4
#: Near duplicates: word shingles of this length, this Jaccard similarity in percent or more.
SHINGLE, PERCENT = 5, 80
#: Numbers of rows that have no id of their own start here.
NO_ID = 2**62


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known; a null lang is filled with it.

    Null, empty and letterless texts go. Others go only where no learned language is given and none stands out. Where no lang is given at all,
    so that nothing can be learned, every text with a letter stays. Repeated rows and rows without an id are judged each for itself. Of two languages with
    equal scores the first by name is taken.
    """
    model = string_kernel.train(docs, "doc_id", "text", "lang")
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh(docs.columns, "lang_pred", "score")
    found = string_kernel.predict(docs, model, keep_text=True, pred_col=lang, score_col=score)
    found = found.where((F.col(lang) != string_kernel.UNKNOWN) & (F.coalesce(F.col("lang").isin(model.langs), F.lit(False)) | (F.col(score) >= LEAST_LANGUAGE_SCORE)))
    return found.withColumn("lang", F.coalesce("lang", lang)).select(*[col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, the one with the least id.

    Rows are told apart by id, where they have one that no other row has, else by a hash of id and text; such rows come after all others. So texts of one id stay unless
    they are copies or near copies, of rows equal in id and text one stays, and rows without an id are judged like all others. Null, empty and blank texts are no duplicates of other ids.
    Of equal texts the least id stays; very long texts are compared whole.
    """
    key, often, gone = fresh(docs.columns, "key", "often", "gone")
    shared = checkpoint(docs.groupBy("doc_id").count().where(f"count > 1 OR doc_id IS NULL OR doc_id >= {NO_ID}").select(F.col("doc_id").alias(often), F.lit(True).alias(gone)))
    some = not shared.isEmpty()
    rows = docs.withColumn(key, F.col("doc_id").cast("long"))
    if some:
        rows = docs.join(small(shared, F.lit(16)), F.col("doc_id").eqNullSafe(F.col(often)), "left")
        hashes = F.lit(NO_ID) + F.shiftright(hashed(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")), F.col("doc_id").isNull(), F.col("text").isNull()), 1)
        rows = rows.withColumn(key, F.when(F.col(gone), hashes).otherwise(F.col("doc_id").cast("long"))).drop(often, gone)
    found = checkpoint(jaccard_join.join(rows, id_col=key, size=SHINGLE, percent=PERCENT))
    copies = checkpoint(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct())
    kept = rows.join(small(copies, F.lit(8)), F.col(key) == F.col(gone), "left_anti")
    if some:
        kept = kept.where(F.col(key) < NO_ID).unionByName(kept.where(F.col(key) >= NO_ID).dropDuplicates([key]))
    return kept.select(*[col(c) for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in brackets in place of each span; n_chars, where there is such a column, becomes the length of the masked text. Null stays null; rows that share id and text are masked alike."""
    i, m, spans = fresh(docs.columns, "i", "m", "spans")
    found = private_data.find(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias(i), F.col("mark").alias(m), F.col("spans").alias(spans))
    found = small(checkpoint(found.dropDuplicates([i, m])), 32 + 32 * F.size(spans))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(m)), "left")
    masked = joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(private_data.masked(F.col("text"), F.col(spans))))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return masked.select(*[col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents, as the sources' target weights ask.

    Null and empty texts stay once; a null source is a source of its own; rows that share id and text may differ by one copy.
    """
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, in place of its text. A null or empty text has none; each row is encoded for itself, a text of any length whole. Of segmentations with equal scores
    the same one is taken on each run."""
    return nbest.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

ORACLE_SQL = None  # kernels, balancing and piece lattices are beyond SQL; tests/llm hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
