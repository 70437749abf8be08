import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Makes a documents table from texts or (id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows, extra=True):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], DOCS)
        if not extra:
            return df
        from pyspark.sql import functions as F

        return df.selectExpr("*", "'x' as key", "1 as id", "'y' as row", "2 as range", "3 as node", "4 as n", "5 as length", "6 as `a.b`").withColumn("spans", F.array(F.lit(1)))

    return make
