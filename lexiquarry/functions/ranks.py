"""Exact global numbering without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(df: DataFrame, bucket: Column, order: list[Column], name: str = "id", first: int = 1, within: list[str] | None = None) -> DataFrame:
    """Number rows from ``first`` in (bucket, order), optionally within the columns ``within``.

    ``bucket`` must keep the order: all rows of a bucket come before those of the next one. Rows
    are numbered within buckets and shifted by the sizes of the buckets before (a small table).
    """
    within = within or []
    part = df.withColumn("_b", bucket)
    sizes = part.groupBy(*within, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*(within or [F.lit(0)])).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_k_{c}") for c in within], F.col("_b").alias("_sb"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_s"))
    cond = F.col("_b").eqNullSafe(F.col("_sb"))
    for c in within:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    at = F.row_number().over(Window.partitionBy(*within, "_b").orderBy(*order))
    out = part.withColumn("_i", at).join(starts, cond)
    return out.withColumn(name, (F.col("_s") + F.col("_i") + (first - 1)).cast("long")).drop("_b", "_sb", "_s", "_i", *[f"_k_{c}" for c in within])


#: Buckets of :func:`totals_before`, and most rows and bytes of its result that :func:`with_offsets` broadcasts.
BUCKETS, BROADCAST_ROWS = 4096, 2_000_000


def totals_before(ids: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """(key, name): the sum of ``n`` over all rows with a smaller numeric ``key``; keys are distinct.

    Keys are dealt to at most BUCKETS ranges of equal width; only the ranges' totals meet in one task.
    """
    low, high = ids.agg(F.min(key), F.max(key)).first()
    if low is None:
        return ids.select(key, F.lit(0).cast("long").alias(name)).limit(0)
    part = ids.withColumn("_b", F.floor((F.col(key) - F.lit(low)) / F.lit((high - low) // BUCKETS + 1)))
    ahead = Window.orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    starts = part.groupBy(F.col("_b").alias("_sb")).agg(F.sum(n).alias("_t")).select("_sb", F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_s"))
    inner = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = part.withColumn("_i", F.coalesce(F.sum(n).over(inner), F.lit(0)))
    return own.join(F.broadcast(starts), F.col("_b") == F.col("_sb")).select(key, (F.col("_s") + F.col("_i")).cast("long").alias(name))


def with_offsets(rows: DataFrame, offsets: DataFrame, key: str) -> DataFrame:
    """``rows`` with their ``offsets`` (a row a key). Counted: a small table is broadcast, so that rows do
    not move; a larger one is joined by shuffle."""
    small = offsets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(offsets) if small else offsets.hint("merge"), key)
