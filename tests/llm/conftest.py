import pytest

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A frame of documents from (doc_id, text[, lang[, source]])."""

    def make(*rows, extra=None):
        full = [(*r, *([None] * (4 - len(r))), None) for r in rows]
        df = spark.createDataFrame(full, TABLE)
        for name in extra or ():  # columns whose names operators use for their own
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
        return df

    return make
