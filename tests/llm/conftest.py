import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside or in their results.
CLASHING = ("score", "size", "ids", "lang_pred", "target", "h", "node", "key", "word", "taken", "bucket", "mark", "spans", "label")


@pytest.fixture(scope="session")
def make(spark):
    """docs(rows of (doc_id, text, lang, source)), with clashing columns if asked."""

    def docs(rows, clash=False):
        df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("kept") for c in CLASHING})
        return df

    return docs


LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(20000))
EDGES = [
    (1, None, "en", "a"),
    (2, "", None, None),
    (3, " \n\t ", "en", None),
    (4, "one word", "en", "a"),
    (4, "one word", "en", "a"),
    (5, "x" * 20000, None, "b"),
    (6, LONG, "en", "b"),
    (7, LONG + " and more", "en", "b"),
    (8, "ÀÉ ▁ 語 😀   tail", "fr", "c"),
    (None, "a row without an id", "en", "c"),
    (9, "!!! 123 ---", "en", "c"),
]
EMPTY: list = []
