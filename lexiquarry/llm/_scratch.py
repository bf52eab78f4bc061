"""Shared scratch storage, exact distributed ranks and small helpers for the corpus operators.

Nothing here keeps state on an executor: intermediate tables are written as Parquet below the
folder the cluster names in ``spark.checkpoint.dir`` so that a lost executor costs only a re-read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiquarry.scratch import discard, materialize, scratch_root  # noqa: F401  (operators take them from here)
from lexiquarry.session import ship

#: Most rows and bytes of a table that is sent to every executor by a broadcast join (checked, never assumed).
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20

WHITE = r"[\x20\x09-\x0D]+"


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def crc32_text(col: Column) -> Column:
    """crc32 of a value's decimal text, as the labelled folds are defined."""
    return F.crc32(col.cast("string").cast("binary"))


def held_out(col: Column) -> Column:
    """True on the fifth of the rows that no training step may read (null ids: false)."""
    return F.coalesce(crc32_text(col) % 5 == 0, F.lit(False))


def running(df: DataFrame, within: list[str], order: list[Column], size: Column, buckets: int, bucket: Column) -> DataFrame:
    """Exact exclusive running totals without ever sorting a whole group in one task.

    Rows of a group (columns ``within``) are dealt to ``buckets`` ordered buckets by ``bucket``
    (an int column from 0). ``before`` is the sum of ``size`` over the group's rows that precede a
    row in (bucket, order); ``rank`` counts those rows. Bucket totals are groups x buckets rows.
    """
    part = df.withColumn("_b", bucket.cast("int")).withColumn("_w", size.cast("long"))
    totals = part.groupBy(*within, "_b").agg(F.sum("_w").alias("_bw"), F.count(F.lit(1)).alias("_bn"))
    ahead = Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(within)],
        F.col("_b").alias("_sb"),
        F.coalesce(F.sum("_bw").over(ahead), F.lit(0)).alias("_sw"),
        F.coalesce(F.sum("_bn").over(ahead), F.lit(0)).alias("_sn"),
    )
    inner = Window.partitionBy(*within, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = part.withColumn("_iw", F.coalesce(F.sum("_w").over(inner), F.lit(0))).withColumn(
        "_in", F.coalesce(F.count(F.lit(1)).over(inner), F.lit(0))
    )
    cond = F.col("_b") == F.col("_sb")
    for i, c in enumerate(within):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = ranked.join(starts, cond).withColumn("before", F.col("_sw") + F.col("_iw")).withColumn("rank", F.col("_sn") + F.col("_in"))
    return out.drop("_b", "_w", "_iw", "_in", "_sb", "_sw", "_sn", *[f"_k{i}" for i in range(len(within))])


def bucket_count(rows: int, per: int = 20_000, least: int = 64) -> int:
    """Buckets for :func:`running` so that one holds about ``per`` rows at any table size."""
    return max(least, -(-rows // per))


def few(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``limit`` rows, and at most ``most`` bytes by the lengths of its values."""
    width_ = F.lit(32)
    for f in df.schema.fields:
        long = f.dataType.typeName() in ("string", "binary")
        width_ = width_ + (F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) if long else F.lit(16))
    rows, size = df.agg(F.count(F.lit(1)), F.sum(width_.cast("long"))).first()
    return rows <= limit and (size or 0) <= most


def join_checked(big: DataFrame, small: DataFrame, on: Column | list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` only if it was counted and measured (see ``few``); else a shuffled join."""
    return big.join(F.broadcast(small) if few(small, limit) else small.hint("merge"), on, how)


#: Most rows and bytes of an Arrow batch: a batch of texts exists several times over in a worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch sizes to these (never raise them).

    Plans read these settings when they run, so the session keeps them.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def arrow_map(df: DataFrame, fn, schema, owner: str | None = None) -> DataFrame:
    """``df.mapInArrow`` with this package's code available on the executors.

    Worker processes are reused: what operators other than ``owner`` kept in one is freed first.
    """
    ship(df.sparkSession)

    def task(batches):
        from lexiquarry.llm import _words

        _words.keep_only(owner)
        yield from fn(batches)
        _words.keep_only(owner)

    small_batches(df.sparkSession)
    return df.mapInArrow(task, schema)


def join_back(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, parts: int = 2000, how: str = "inner") -> DataFrame:
    """Join of ``rows`` with one-row-per-key ``table`` whose ``count`` says how many rows a key has.

    Keys with more than ``total / parts`` rows number fewer than ``parts`` and are broadcast, so
    that no task receives all rows of a hot key; the others are joined by shuffle. ``how`` is inner
    or left.
    """
    small = table.withColumnRenamed(key, "_key")
    hot = F.broadcast(small.where(F.col(count) * parts > total).select(F.struct(*small.columns).alias("_hot")))
    marked = rows.join(hot, F.col(key) == F.col("_hot._key"), "left")
    shape = [c for c in small.columns if c != "_key"]
    a = marked.where(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in shape])
    cold = small.where(F.col(count) * parts <= total)
    b = marked.where(F.col("_hot").isNull()).select(*rows.columns).join(cold, F.col(key) == F.col("_key"), how).select(*rows.columns, *shape)
    return a.unionByName(b)
