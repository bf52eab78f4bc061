"""Line deduplication that moves hashes, not texts.

1. Every long enough line becomes (key hash, document, positions): one row per distinct key of a
   document. The rows are written once.
2. They are range-partitioned by (hash, document) and sorted within partitions by hash, document
   (largest first) and position. A stream over a partition meets a key's keeper first; each later
   document of a key with at least ``min_docs`` documents is dropped. The stream holds at most
   ``LIMIT`` rows, whatever the size of the key.
3. A key may continue in the next partition (a common line covers many). A partition's first and
   last key are therefore left open: their rows are passed on with a count per partition, and one
   small join (at most two counts a partition) settles them.
4. Dropped positions are gathered per document into a zlib-compressed bitmap of the lines kept.

Defined results
  null or empty text       one empty line, kept
  null doc_id              all rows without an id count as one document, smaller than any other
  one doc_id, more texts   count as one document; each text gets its own bitmap
  empty table              no rows
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm._scratch import arrow_map, join_checked, materialize
from lexiquarry.llm._words import raw

MIN_CHARS, MIN_DOCS = 20, 3
#: Rows of a range partition, about.
PART_ROWS = 400_000
#: Rows of one key that wait for its end before the key is passed on open.
LIMIT = 50_000

_KEYS = "h binary, doc_id long, th long, n_lines int, first int, pos binary"


def _chars(key: bytes, least: int) -> bool:
    """Whether ``key`` has at least ``least`` code points."""
    return len(key) >= 4 * least or (len(key) >= least and len(key.decode()) >= least)


def line_keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, doc_id, th, n_lines, first, pos): one row per document and distinct key."""

    def run(batches):
        for b in batches:
            out = []
            for i, th, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2))):
                lines = t.split(b"\n")
                found: dict[bytes, list[int]] = {}
                for k, line in enumerate(lines):
                    if len(line) >= min_chars:
                        key = line.strip().lower()
                        if _chars(key, min_chars):
                            found.setdefault(xxhash.xxh3_128_digest(key), []).append(k)
                n = len(lines)
                out.extend((h, i, th, n, p[0], np.array(p, dtype="<u4").tobytes()) for h, p in found.items())
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["h", "doc_id", "th", "n_lines", "first", "pos"])

    return arrow_map(fingerprinted(docs, text, doc_id), run, _KEYS)


def fingerprinted(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("text"))


#: What the stream emits: 0 a dropped row, 1 a count of an open key (n documents), 2 a row of an open key.
DROP, COUNT, OPEN = 0, 1, 2


def resolve(batches, min_docs: int):
    """Walk a partition's rows, sorted by (h, doc_id descending, first); yield lists of output rows.

    The first and the last key of a partition are open. Which key is the last is only known at the
    end, so a key is settled when the next one begins; a key of ``LIMIT`` rows or more is passed on
    open from there, which is always correct and bounds the memory.
    """
    first = True
    key: bytes | None = None
    rows: list[tuple] = []
    spilled = False  # the current key is open: its rows are passed on at once
    n_docs, top, last = 0, None, None
    out: list[tuple] = []

    def close(is_open: bool) -> None:
        nonlocal rows
        if key is None:
            return
        if is_open or spilled:
            out.append((COUNT, key, top, None, None, None, n_docs))
            out.extend((OPEN, *r, None) for r in rows)
        elif n_docs >= min_docs:
            out.extend((DROP, *r, None) for r in rows if r[1] != top)
        rows = []

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("h", "doc_id", "th", "n_lines", "pos")]
        for row in zip(*cols):
            if row[0] != key:
                close(first)
                first = key is None
                key, top, last, n_docs, spilled = row[0], row[1], row[1], 1, False
            elif row[1] != last:
                last, n_docs = row[1], n_docs + 1
            rows.append(row)
            if len(rows) >= LIMIT:
                spilled = True
                out.extend((OPEN, *r, None) for r in rows)
                rows = []
        if len(out) > 20_000:
            yield out
            out = []
    close(True)
    yield out


def dropped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, th, n_lines, pos) of lines to drop; ``pos`` packs little-endian uint32 positions."""
    keys = materialize(line_keys(docs, text, doc_id, min_chars), "line-keys")
    parts = max(1, -(-keys.count() // PART_ROWS))
    ranged = keys.repartitionByRange(parts, F.col("h"), F.col("doc_id").desc_nulls_last())
    ranged = ranged.sortWithinPartitions(F.col("h"), F.col("doc_id").desc_nulls_last(), F.col("first"))
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
    names = ["kind", "h", "doc_id", "th", "n_lines", "pos", "n"]

    def run(batches):
        for out in resolve(batches, min_docs):
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    seen = materialize(arrow_map(ranged, run, "kind int, h binary, doc_id long, th long, n_lines int, pos binary, n long"), "line-stream")
    counts = seen.where(F.col("kind") == COUNT).groupBy(F.col("h").alias("k")).agg(F.sum("n").alias("docs"), F.max("doc_id").alias("top"))
    counts = counts.where(F.col("docs") >= min_docs)
    rows = ["doc_id", "th", "n_lines", "pos"]
    open_rows = join_checked(seen.where(F.col("kind") == OPEN), counts, F.col("h") == F.col("k"))
    settled = open_rows.where(~F.col("doc_id").eqNullSafe(F.col("top"))).select(*rows)
    return seen.where(F.col("kind") == DROP).select(*rows).unionByName(settled)


def keep_bitmaps(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, th, keep) of each document that loses a line.

    ``keep`` is the zlib-compressed bitmap of its lines, most significant bit first, 1 for a line
    that stays. Other documents keep everything and have no row.
    """
    gathered = dropped(docs, text, doc_id, min_chars, min_docs).groupBy("doc_id", "th").agg(F.max("n_lines").alias("n"), F.collect_list("pos").alias("pos"))

    def run(batches):
        for b in batches:
            out = []
            for n, pos in zip(b.column("n").to_pylist(), b.column("pos").to_pylist()):
                keep = np.ones(n, dtype=bool)
                keep[np.frombuffer(b"".join(pos), dtype="<u4")] = False
                out.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(out, pa.binary())], names=["doc_id", "th", "keep"])

    return arrow_map(gathered, run, "doc_id long, th long, keep binary")


def surviving(text: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    """(lines, lines dropped, remaining text) of one document."""
    lines = text.split(b"\n")
    if keep is None:
        return len(lines), 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)]
    kept = [x for x, k in zip(lines, bits) if k]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the column ``_keep``; texts move only if there are too many bitmaps to broadcast."""
    maps = materialize(bitmaps, "line-bitmaps").select(F.col("doc_id").alias("__lq_id"), F.col("th").alias("__lq_th"), F.col("keep").alias("__lq_keep"))
    th = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    on = F.col(doc_id).cast("long").eqNullSafe(F.col("__lq_id")) & (th == F.col("__lq_th"))
    return join_checked(docs, maps, on, "left").drop("__lq_id", "__lq_th")


def apply(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` (all columns) with the surviving lines as text."""
    columns = docs.columns
    at, schema = columns.index(text), docs.schema
    marked = with_bitmaps(docs, keep_bitmaps(docs, text, doc_id), text, doc_id)

    def run(batches):
        for b in batches:
            cols = list(b.columns[: len(columns)])
            keeps, texts = b.column(len(columns)).to_pylist(), cols[at].to_pylist()
            out = [t if k is None else surviving((t or "").encode(), k)[2].decode() for t, k in zip(texts, keeps)]
            cols[at] = pa.array(out, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return arrow_map(marked.select(*columns, "__lq_keep"), run, schema)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = with_bitmaps(docs, keep_bitmaps(docs))

    def run(batches):
        for b in batches:
            rows = [surviving(t, k) for t, k in zip(raw(b.column(1)), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return arrow_map(marked.select("doc_id", "text", "__lq_keep"), run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), s AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.line, k.i, (s.key IS NOT NULL AND k.doc_id <> s.top) AS gone FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
