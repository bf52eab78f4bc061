"""Mixing sources to target weights as a time-varying curriculum.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share ``budget``
times all words. No source gets more than ``cap`` times its words; the excess is shared again by
weight among the others until none is above.

Taking: a source's documents are put in a fixed hashed order and read from the start, again and
again, until the source's target is met; the last document is taken in part.

Curriculum: over training time t in [0, 1] a source is drawn with weight
target * (1 + slope * (1 - 2t)): early, late or even (slope 1/2, -1/2, 0 by the source's place).
Integrating gives the words demanded up to t, target * (t + slope * (t - t^2)); inverting that at
the word on which a use of a document begins gives the use's position. Uses are range-sorted by it.

Running totals are exact and never sort a whole source in one task (see ``running``).

Defined results
  null or empty text   size 0, taken 0, no position
  null source          a source of its own, last in the order
  repeated rows        each is a document
  ties                 equal hashes of ids go by id, then by row
  very long texts      only their number of words is kept
  extra columns        are ignored, whatever their names
  empty table          no rows
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.llm._scratch import WHITE, arrow_map, bucket_count, join_checked, materialize, running
from lexiquarry.llm._words import raw

WEIGHTS, BUDGET, CAP, SLOPES = (3, 1, 2), 1.5, 2, (0.5, -0.5, 0.0)


def sizes(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(uid, doc_id, source, th, size): words and a fingerprint of every whole text."""

    def run(batches):
        for b in batches:
            n = pa.array([len(t.split()) for t in raw(b.column(4))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], n], names=["uid", "doc_id", "source", "th", "size"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("th"),
        F.col(text).cast("string").alias("text"),
    )
    return arrow_map(rows, run, "uid long, doc_id long, source string, th long, size long")


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds ``place``: sources by code point from 0, null last. They are range-sorted; only counts per
    partition meet in one task."""
    order = F.col("source").asc_nulls_last()
    ranged = materialize(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "mix-ranged")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), part == F.col("_p")).withColumn("place", F.col("_start") + at).drop("_at", "_p", "_start")


def targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP, slopes=SLOPES) -> DataFrame:
    """(source, source_size, target, slope): one row per source.

    Each round of sharing brings one row of sums to the driver, never the sources themselves.
    """
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))
    table = _numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    table = table.withColumns({"weight": pick(weights, F.col("place")), "slope": pick(slopes, F.col("place"))})
    table = materialize(table, "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, over = 0.0, None
    while True:
        full = F.lit(False) if over is None else F.lit(over) * F.col("weight") > F.lit(cap) * F.col("source_size")
        r = table.agg(F.sum(F.when(full, F.lit(cap) * F.col("source_size")).otherwise(0)).alias("c"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("w"), F.sum(full.cast("int")).alias("n")).first()
        if not r.w:
            break
        level = (budget * total - r.c) / r.w
        if over == level:
            break
        over = level
    share = F.lit(level) * F.col("weight")
    most = F.lit(cap) * F.col("source_size")
    return table.select("source", "source_size", F.when(share > most, most.cast("double")).otherwise(share).alias("target"), "slope")


def position(at, target, slope):
    """The time t at which target * (t + slope * (t - t^2)) reaches ``at``."""
    c = at / target
    k = F.lit(1.0) + slope
    return F.when(slope == 0, c).otherwise((k - F.sqrt(k * k - F.lit(4.0) * slope * c)) / (F.lit(2.0) * slope))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: uid, doc_id, source, th, size, source_size, target, slope, before, taken."""
    sized = materialize(sizes(docs, text, source, doc_id), "mix-sizes")
    n = sized.count()
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    buckets = bucket_count(n)
    bucket = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(float(1 << 32)))
    ordered = running(sized.withColumn("key", key), ["source"], [F.col("key"), F.col("doc_id"), F.col("uid")], F.col("size"), buckets, bucket)
    per = targets(sized).withColumnRenamed("source", "_source")
    rows = join_checked(ordered, per, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "key", "rank")
    demand = F.floor(F.col("target") + F.lit(0.5))
    passes = F.when(F.col("source_size") > 0, F.floor(demand / F.col("source_size"))).otherwise(0)
    rest = demand - passes * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return rows.withColumn("taken", (passes * F.col("size") + last).cast("long"))


def each_use(mixed: DataFrame) -> DataFrame:
    """One row per use of a document: uid, doc_id, source, th, size, use, words, position.

    ``words`` is less than ``size`` for the use with which a source meets its target: its first words
    are taken.
    """
    n = F.ceil(F.col("taken") / F.col("size")).cast("int")
    each = mixed.where(F.col("taken") > 0).withColumn("use", F.explode(F.sequence(F.lit(0), n - 1)))
    at = F.col("before") + F.col("use") * F.col("source_size")
    words = F.least(F.col("size"), F.col("taken") - F.col("use") * F.col("size"))
    return each.select("uid", "doc_id", "source", "th", "size", "use", words.alias("words"), position(at, F.col("target"), F.col("slope")).alias("position"))


def uses(mixed: DataFrame) -> DataFrame:
    """The curriculum: every use (see :func:`each_use`), range-sorted by training position."""
    return each_use(mixed).orderBy("position", "doc_id", "uid", "use")


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word (it must have more words)."""
    leading = F.when(text.rlike(f"^{WHITE}"), 1).otherwise(0)
    rest = F.element_at(F.split(text, WHITE, (n + leading + 1).cast("int")), -1)
    return F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(rest)), f"{WHITE}$", "")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """``position`` is that of the first use (null if the mix takes nothing); rows are sorted by it."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = F.when(F.col("taken") > 0, position(F.col("before"), F.col("target"), F.col("slope")))
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         CASE place % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN -0.5::DOUBLE ELSE 0::DOUBLE END AS slope,
         (SELECT sum(size) FROM d) AS total
  FROM s
), p AS (
  SELECT *, row_number() OVER o AS k,
         coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, place)
), level AS (
  SELECT (1.5::DOUBLE * total::DOUBLE - capped::DOUBLE) / open_weight::DOUBLE AS lam FROM p
  WHERE (1.5::DOUBLE * total::DOUBLE - capped::DOUBLE) / open_weight::DOUBLE * weight <= 2 * source_size
  ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, slope,
         CASE WHEN lam * weight > 2 * source_size THEN (2 * source_size)::DOUBLE ELSE lam * weight END AS target
  FROM w, level
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
         CAST(floor(t.target + 0.5) AS BIGINT) AS demand
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT *, CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END AS passes FROM r
), g AS (
  SELECT *, CAST(passes * size + greatest(0, least(size, demand - passes * source_size - before)) AS BIGINT) AS taken FROM f
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN
         CASE WHEN slope = 0 THEN before / target
              ELSE ((1.0::DOUBLE + slope) - sqrt((1.0::DOUBLE + slope) * (1.0::DOUBLE + slope) - 4.0::DOUBLE * slope * (before / target))) / (2.0::DOUBLE * slope)
         END END AS position
FROM g
"""
