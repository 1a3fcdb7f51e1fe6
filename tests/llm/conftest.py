import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text) or (doc_id, text, lang, source) rows, with columns whose names clash with results."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            from pyspark.sql import functions as F

            for name in ("n_words", "size", "kept", "shard", "spans", "rank", "w", "k1", "found"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
