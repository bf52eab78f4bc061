"""Bounded, deterministic samples of labelled documents for training on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.llm._scratch import held_out


def learnable(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """One row per labelled document outside the held-out fold: (doc_id, label).

    Several labels of one document: the largest counts. Null ids and null labels are left out.
    """
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    return rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))


def draw(rows: DataFrame, limit: int, seed: int, where: Column | None = None) -> DataFrame:
    """At most ``limit`` of ``rows``, the first ones by hashed id (a top-k, not a sort)."""
    rows = rows if where is None else rows.where(where)
    return rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(limit)


#: Most bytes of the texts of one label in a sample that goes to the driver.
SAMPLE_BYTES = 32 << 20


def with_text(docs: DataFrame, sample: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int | None = None) -> DataFrame:
    """(doc_id, label, text) of a drawn sample (doc_id, label): one text for each id, the smallest.

    Rows are bounded by the sample, which is broadcast, however often an id occurs in ``docs``. With
    ``most`` the texts of a label have at most so many bytes: texts are taken by hashed id, and one
    that would go beyond is left out.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    if most is None:
        return one
    ahead = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id")  # over the bounded sample
    return one.withColumn("_n", F.sum(F.octet_length("text")).over(ahead)).where(F.col("_n") <= most).drop("_n")


def draw_unlabelled(docs: DataFrame, limit: int, seed: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``limit`` ids (doc_id) of documents outside the held-out fold, whether labelled or not, by hash.

    A threshold on the hash leaves a small multiple of ``limit`` before ids are made distinct.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rate = int(min(1.0, 3.0 * limit / max(1, ids.count())) * (1 << 30))
    few_ids = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < rate).distinct()
    return few_ids.orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").limit(limit)
