"""Line-local stages on a stream: the same column functions, no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.operators.definitions import of_classes, preprocess
from lexiquarry.sources.readers import tab_dictionary


def definition_stream(spark: SparkSession, path: str, classes: list[str] | None = None) -> DataFrame:
    """Dictionary lines as files arrive in ``path``: cleaned, one row per alternative.

    Ids are not numbered: a sequence over an unbounded stream has no end to count from.
    """
    lines = spark.readStream.schema("value string").text(path).select(F.col("value").alias("line"))
    rows = of_classes(preprocess(tab_dictionary(lines)), classes or [])
    return rows.select("term", "word_class", "definition", F.explode("parts").alias("part"))
