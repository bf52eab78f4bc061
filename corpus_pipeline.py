"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``.

quality   documents that the compression classifier rejects (score below 0.3) go
lines     repeated lines leave the texts; a document all of whose lines go stays, empty
near      of each group of near-duplicates the document with the smallest id stays
mix       each document is repeated as often as the mix takes it, in the order of the curriculum;
          documents that it does not take go
pack      what remains is packed into sequences (one row per piece)
"""

from __future__ import annotations

import operator
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiquarry.llm import line_dedup, mixing, near_dedup, packing, quality_classifier
from lexiquarry.llm._scratch import few, join_checked, materialize, width


#: Words of a range partition of the curriculum, about (some 60 MB of text).
PART_WORDS = 10_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is at least 0.3 stay as they are, null and empty texts included; rows are judged
    one by one, so repeated rows share their fate. Without labels every row stays (score 0.5)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; repeated lines leave their texts (null texts stay null), and n_chars follows."""
    out = line_dedup.apply(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _identity(docs: DataFrame):
    """The pair that stands for a document: its id and a fingerprint of its text."""
    return F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every member of a group but the first; only dropped ids are joined with the texts.

    Rows without an id stay unless they are linked with a row that has one.
    """
    found = materialize(near_dedup.near_duplicates(docs), "pipeline-near")
    members = found.where("n_component > 1 and component_id is not null")
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # Several rows of a component may carry the id that stays: its first text stays, once.
    again = members.where(own).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("th").alias("__lq_first"), F.first("component_id").alias("__lq_again"))
    again = materialize(again.where("n > 1").select(F.col("root").alias("__lq_root"), "__lq_first", "__lq_again"), "pipeline-again")
    repeated = bool(again.head(1))
    identity = [F.col("doc_id").alias("__lq_id"), F.col("th").alias("__lq_th")]
    gone = members.where(~own).select(*identity)
    if repeated:
        others = members.where(own).join(again, F.col("root") == F.col("__lq_root")).where(F.col("th") != F.col("__lq_first"))
        gone = gone.unionByName(others.select(*identity))
    gone = materialize(gone.distinct(), "pipeline-gone")
    i, th = _identity(docs)
    kept = join_checked(docs, gone, i.eqNullSafe(F.col("__lq_id")) & (th == F.col("__lq_th")), "left_anti")
    if not repeated:
        return kept
    w = Window.partitionBy(i, th).orderBy(*[F.col(c) for c in kept.columns if c not in ("doc_id", "text")])
    flagged = kept.join(F.broadcast(again) if few(again) else again, (i == F.col("__lq_again")) & (th == F.col("__lq_first")), "left")
    single = flagged.where(F.col("__lq_again").isNotNull()).withColumn("__lq_n", F.row_number().over(w)).where("__lq_n = 1")
    return flagged.where(F.col("__lq_again").isNull()).select(*docs.columns).unionByName(single.select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as a curriculum: a row for every use of a document, sorted by training position.

    The words of all rows of a source are those that ``mixing.mix`` takes: a document that is used k
    times has k rows, and the use with which its source meets its target has the document's first words
    only (at most one row a source). Documents that the mix does not take go, as do empty ones.
    Rows that share id, source and text are each mixed; their uses are rows of one of them.
    Null ids and sources are values like others; an empty table stays empty.
    """
    key, columns = ["__lq_id", "__lq_th", "__lq_source"], docs.columns
    named = [F.col("doc_id").alias(key[0]), F.col("th").alias(key[1]), F.col("source").alias(key[2])]
    mixed = materialize(mixing.mix(docs), "pipeline-mixed")
    plan = mixing.each_use(mixed).select(*named, F.col("size").alias("__lq_size"), F.col("words").alias("__lq_words"), F.col("use").alias("__lq_use"), F.col("position").alias("__lq_at"))
    plan = materialize(plan, "pipeline-uses")
    i, th = _identity(docs)
    same = lambda a, b: reduce(operator.and_, [x.eqNullSafe(F.col(y)) for x, y in zip(a, b)])
    own = [i, th, F.col("source").cast("string")]
    again = materialize(mixed.groupBy(*named).count().where("count > 1").drop("count"), "pipeline-again")
    if again.head(1):  # rows that stand for the same document: one of them stays
        other = [c for c in columns if c not in ("doc_id", "source", "text")]
        one = join_checked(docs, again, same(own, key)).groupBy(*key).agg(F.min(F.struct("doc_id", "source", "text", *other)).alias("one"))
        docs = join_checked(docs, again, same(own, key), "left_anti").unionByName(one.select([F.col(f"one.`{c}`").alias(c) for c in columns]))
    used = join_checked(docs, plan, same(own, key))
    part = F.col("__lq_words") < F.col("__lq_size")
    text = F.when(part, mixing.first_words(F.col("text"), F.col("__lq_words"))).otherwise(F.col("text"))
    used = used.withColumn("text", text.cast(docs.schema["text"].dataType))
    if "n_chars" in columns:
        used = used.withColumn("n_chars", F.when(part, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    words = plan.agg(F.sum("__lq_words")).first()[0] or 0
    order = ["__lq_at", *key, "__lq_use"]
    parts = max(width(spark), words // PART_WORDS)
    return used.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, as ``packing.pack`` returns them; a null or empty text is one separator, repeated
    rows are packed each, an empty table has no rows."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("pack", pack)]

#: The first stage is a trained compressor: no SQL expresses it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}-{uuid.uuid4().hex[:6]}")
    return STAGES[-1][1](spark, docs, sf_dir)
