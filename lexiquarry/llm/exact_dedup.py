"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Digests (SHA-256 of the white-space-normalised text) are computed once and written: 50 bytes a row
instead of the text. Then

pass 1  a Bloom filter, sharded into 64-bit words, is built by a partial aggregation: a digest
        picks a word and a bit; of each word only the OR of the bits and the number of insertions
        move. A word with more insertions than bits set has possibly seen a digest twice; with as
        many, it certainly has not. The filter has about 64 bits a digest at any input size.
pass 2  the flagged words become a bit table of at most ``TABLE_BITS`` bits (64 MB), which every task
        probes. Rows without a bit are unique: they pass straight through and are never shuffled, at
        any input size. Only rows with a bit ("possibly repeated") are shuffled by digest, which
        settles false positives exactly. Where there are more words than bits, words share a bit;
        that only makes more rows possibly repeated.

A digest that holds a large share of the rows is one row after the partial aggregation; it joins
back by broadcast (there can be at most ``HOT_PARTS`` such digests), so that no task receives its
rows.

Defined results
  null text                 counts as empty text
  null doc_id               comes after every other id; if a group has null ids only, keep_id is null
  one doc_id on equal texts exactly one of the rows stays (the one read first)
  extra columns             are ignored, whatever their names
  empty table               no rows
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm._scratch import WHITE, materialize

#: A digest with more than 1/HOT_PARTS of the rows is joined back by broadcast.
HOT_PARTS = 2000
#: Bits of the table of flagged words, at most; a row of the table holds 64 words of 64 bits.
TABLE_BITS = 1 << 29


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(uid, doc_id, sha): ``uid`` numbers the rows once the table is written."""
    normal = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), WHITE, " ")
    sha = F.unhex(F.sha2(normal.cast("binary"), 256))
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), sha.alias("sha"))


def _word(rows: DataFrame, n: int) -> DataFrame:
    """Each digest's word and bit in a filter with one 64-bit word for each of ``n`` digests."""
    words = 1 << max(4, (max(1, n) - 1).bit_length())
    h = F.xxhash64("sha")
    bit = F.expr("shiftleft(cast(1 as bigint), cast(pmod(xxhash64(sha), 64) as int))")
    return rows.withColumns({"word": F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1)), "bit": bit})


def possibly_repeated(rows: DataFrame, n: int) -> DataFrame:
    """Flagged filter words: those where some bit may have been set twice."""
    words = _word(rows, n).groupBy("word").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n"))
    return words.where(F.bit_count("bits") < F.col("n")).select("word")


def bit_table(flagged: DataFrame, bits: int) -> DataFrame:
    """(chunk, row): the table's rows as arrays of 64 longs; at most ``bits`` / 4096 rows of 512 bytes."""
    at = flagged.select(F.col("word").bitwiseAND(F.lit(bits - 1)).alias("at"))
    bit = F.expr("shiftleft(cast(1 as bigint), cast(at & 63 as int))")
    long = at.groupBy(F.shiftright("at", 12).alias("chunk"), F.shiftright("at", 6).bitwiseAND(F.lit(63)).cast("int").alias("i")).agg(F.bit_or(bit).alias("bits"))
    longs = [F.coalesce(F.max(F.when(F.col("i") == i, F.col("bits"))), F.lit(0).cast("long")) for i in range(64)]
    return long.groupBy("chunk").agg(F.array(*longs).alias("row"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (lowercase hex)."""
    rows = materialize(digests(docs, text, doc_id), "dedup-digests")
    n = rows.count()
    bits = min(TABLE_BITS, 1 << max(12, (max(1, n) - 1).bit_length()))
    table = materialize(bit_table(possibly_repeated(rows, n), bits), "dedup-flagged")
    at = _word(rows, n).withColumn("at", F.col("word").bitwiseAND(F.lit(bits - 1))).drop("bit", "word")
    probed = at.join(F.broadcast(table), F.shiftright("at", 12) == F.col("chunk"), "left")
    hit = F.expr("coalesce(shiftright(get(row, cast(shiftright(at, 6) & 63 as int)), cast(at & 63 as int)) & 1, 0) = 1")
    marked = probed.select("uid", "doc_id", "sha", hit.alias("hit"))
    once = marked.where(~F.col("hit")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    again = marked.where("hit").drop("hit")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), F.col("doc_id").alias("id"), F.col("uid").alias("uid")))
    groups = materialize(again.groupBy("sha").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    groups = groups.select(F.col("sha").alias("group"), F.col("first.id").alias("keep_id"), F.col("first.uid").alias("keep_uid"), "group_size")
    hot = F.broadcast(groups.where(F.col("group_size") * HOT_PARTS > n))  # fewer than HOT_PARTS rows
    by_hot = again.join(hot, F.col("sha") == F.col("group"), "left")
    cold = groups.where(F.col("group_size") * HOT_PARTS <= n)
    shape = ["doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "sha"]
    in_hot = by_hot.where(F.col("group").isNotNull()).select(*shape)
    in_cold = by_hot.where(F.col("group").isNull()).select("uid", "doc_id", "sha").join(cold, F.col("sha") == F.col("group")).select(*shape)
    out = once.unionByName(in_hot).unionByName(in_cold)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
