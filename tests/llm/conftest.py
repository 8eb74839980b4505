import pytest


@pytest.fixture
def docs(spark):
    """A table of documents read from files, from rows (doc_id, text) or (doc_id, text, lang, source)."""
    import tempfile

    def make(rows, extra=None):
        rows = [(*r, *(None,) * (4 - len(r)), None) for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for name, value in (extra or {}).items():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(value))
        path = tempfile.mkdtemp() + "/d"
        df.write.parquet(path)
        return spark.read.parquet(path)

    return make
