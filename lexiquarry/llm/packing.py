"""Best-fit packing of token sequences by planning over a length histogram.

1. Every document is tokenized once; pieces of at most ``capacity`` tokens are written without
   their tokens (id, place, length, checksum). A writing task numbers its pieces within a length.
2. The histogram (pieces of each length: at most ``capacity`` rows) goes to the driver, which packs
   *counts*: lengths from long to short, each into the bins with the smallest room that fits. Bins
   in the same state are one entry, so planning does not depend on the number of documents.
3. The plan says: of the pieces of length L, ranks [r, r + n) take offset o in sequences [s, s + n).
   A piece finds its slot by its rank within its length: task offset plus number in the task.

A document is its token ids followed by one separator id 0; only documents longer than the
capacity are cut.

Tokens are looked up by piece of a word: the tokenizer's pattern never matches white space and it has
no word-crossing normalisation, so a text's ids are its words' ids in order, and a word's ids are those
of the pieces that the pattern divides it into.

Defined results
  null or empty text   one piece: the separator
  repeated rows        packed each on its own
  empty table          no rows
"""

from __future__ import annotations

import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.llm._scratch import arrow_map, materialize
from lexiquarry.llm._words import KEPT, raw

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of text that are looked up at a time, and distinct pieces of words that a worker remembers.
CHUNK, REMEMBERED = 2_000_000, 200_000
#: Classes of bytes. WHOLE marks what only the tokenizer itself may divide.
WHITE, LETTER, DIGIT, OTHER, WHOLE = range(5)


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, its lower case) for ASCII and the letters of U+00C0 to U+00FF in UTF-8.

    A byte after 0xC3 is such a letter, but for the signs U+00D7 and U+00F7 (second bytes 0x97, 0xB7).
    Other lead bytes, control characters and the apostrophe (contractions) make a word WHOLE.
    """
    kind = np.full(256, WHOLE, dtype=np.uint8)
    kind[0x21:0x7F] = OTHER
    kind[[0x20, *range(0x09, 0x0E)]] = WHITE
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[ord("A") : ord("Z") + 1] = kind[ord("a") : ord("z") + 1] = LETTER
    kind[0xC3] = kind[0x80:0xC0] = LETTER
    kind[[ord("'"), 0x97, 0xB7]] = WHOLE
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    lower[0x80:0x9F] += 32
    return kind, lower


KIND, LOWER = _byte_tables()


def divide(text: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(place in ``text``, lower-cased bytes, wholeness) of every piece of words.

    The tokenizer's own division: runs of letters, single digits, runs of anything else. A word that
    needs more than that (see ``_byte_tables``, and ``<|``, which starts a special token) is one piece
    with its bytes as they are.
    """
    kind = KIND[text]
    kind[np.flatnonzero((text[:-1] == ord("<")) & (text[1:] == ord("|")))] = WHOLE
    word = kind != WHITE
    low = LOWER[text]
    odd = np.flatnonzero(kind == WHOLE)
    if len(odd):
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False))  # starts and ends of words in turn
        at = np.unique(np.searchsorted(edges[0::2], odd, side="right") - 1)
        step = np.zeros(len(text) + 1, dtype=np.int8)
        step[edges[0::2][at]] = 1
        step[edges[1::2][at]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        kind[inside] = WHOLE
        low[inside] = text[inside]
    first = word & ((kind == DIGIT) | (np.diff(kind, prepend=np.uint8(WHITE)) != 0))
    place = np.flatnonzero(first)
    ends = np.append(np.flatnonzero(first[word]), np.count_nonzero(word)).astype(np.int32)
    body = low[word]
    pieces_ = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(ends), pa.py_buffer(body)])
    return place, pieces_, kind[place] == WHOLE


class Encoder:
    """Texts to token ids, by whole arrays.

    Pieces of words recur far more often than words do, so ids are kept by piece: a flat array of ids
    with a start and a number for each piece. New pieces are encoded many at a time, joined by spaces:
    a piece's last token, and no other, is an end-of-word token, so the ids divide themselves.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._keep(pa.array([], pa.binary()), *[np.empty(0, dtype=np.int64)] * 3, np.empty(0, dtype="<u4"))

    def _keep(self, names: pa.Array, start, number, used, flat) -> None:
        self.names, self.start, self.number, self.used, self.flat = names, start, number, used, flat

    def _whole(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, names: list[bytes], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of each)."""
        number, ids = np.zeros(len(names), dtype=np.int64), [np.empty(0, dtype="<u4")] * len(names)
        plain = np.flatnonzero(~whole)
        out = []
        for at in range(0, len(plain), 2000):
            group = plain[at : at + 2000]
            words = [names[k].decode() for k in group]
            got = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) != len(group):  # no vocabulary known does this; be exact all the same
                each = self._whole(words)
                got, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            number[group] = np.diff(ends, prepend=0)
            out.append(got)
        odd = np.flatnonzero(whole)
        for k, x in zip(odd.tolist(), self._whole([names[k].decode() for k in odd.tolist()])):
            number[k], ids[k] = len(x), x
        if not len(odd):
            return np.concatenate(out or [np.empty(0, dtype="<u4")]), number
        flat, at = np.concatenate(out or [np.empty(0, dtype="<u4")]), 0
        for k in plain.tolist():
            ids[k] = flat[at : at + number[k]]
            at += number[k]
        return np.concatenate(ids), number

    def _find(self, names: pa.Array, whole: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Numbers of the distinct ``names`` in the memory; new ones are learnt first."""
        import pyarrow.compute as pc

        at = pc.index_in(names, value_set=self.names)
        new = at.is_null()
        fresh = np.flatnonzero(new.to_numpy(zero_copy_only=False))
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        if len(fresh):
            added = names.filter(new)
            flat, number = self._learn(added.to_pylist(), whole[fresh])
            at[fresh] = len(self.names) + np.arange(len(fresh))
            start = len(self.flat) + np.cumsum(number) - number
            used = np.zeros(len(fresh), dtype=np.int64)
            self._keep(
                pa.concat_arrays([self.names, added]),
                *[np.concatenate(x) for x in ((self.start, start), (self.number, number), (self.used, used), (self.flat, flat))],
            )
        self.used[at] += times
        return at

    def _forget(self) -> None:
        """Keep the pieces met most often once more than ``REMEMBERED`` are held, or any long one is."""
        size = np.diff(np.frombuffer(self.names.buffers()[1], dtype=np.int32)[self.names.offset :][: len(self.names) + 1]) if len(self.names) else np.empty(0)
        stay = size <= 64  # long words are not worth the memory
        if stay.sum() > REMEMBERED:
            order = np.argsort(np.where(stay, self.used, -1), kind="stable")
            stay[order[: -REMEMBERED // 2]] = False
        if stay.all():
            return
        number = self.number[stay]
        flat = self.flat[_ranges(self.start[stay], number)]
        self._keep(self.names.filter(pa.array(stay)), np.cumsum(number) - number, number, self.used[stay], flat)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; texts must not begin or end within a word."""
        text = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        if not len(text):
            return []
        place, named, whole = divide(text)
        named = named.dictionary_encode()
        codes = named.indices.to_numpy()
        is_whole = np.zeros(len(named.dictionary), dtype=bool)
        is_whole[codes[whole]] = True
        at = self._find(named.dictionary, is_whole, np.bincount(codes, minlength=len(is_whole)))[codes]
        number = self.number[at]
        ids = self.flat[_ranges(self.start[at], number)]
        self._forget()
        cuts = np.append(0, np.cumsum(number))[np.searchsorted(place, bounds)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _ranges(start: np.ndarray, number: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (number[0] of them), start[1], .."""
    total = int(number.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(number) - number), number)


def encoder(path: str) -> Encoder:
    """The encoder of a worker process; it outlives the task, until another operator's task comes."""
    name = f"packing {path}"
    if name not in KEPT:
        KEPT[name] = Encoder(path)
    return KEPT[name]


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _segments(texts: list[bytes]):
    """Lists of (text's number, part of it) of about CHUNK bytes together; long texts are divided at white space."""
    group, size = [], 0
    for k, t in enumerate(texts):
        at = 0
        while True:
            gap = _GAP.search(t, at + CHUNK - size) if len(t) - at > CHUNK - size else None
            end = gap.start() if gap else len(t)
            group.append((k, t[at:end] if at or gap else t))
            size += end - at
            if size >= CHUNK:
                yield group
                group, size = [], 0
            at = end
            if not gap:
                break
    if group:
        yield group


def encode_texts(words: Encoder, texts: list[bytes]):
    """(text's number, ids) of every text, in order."""
    open_, held = None, []
    for group in _segments(texts):
        for (k, _), ids in zip(group, words.encode([t for _, t in group])):
            if k != open_ and open_ is not None:
                yield open_, held[0] if len(held) == 1 else np.concatenate(held)
                held = []
            open_ = k
            held.append(ids)
    if open_ is not None:
        yield open_, held[0] if len(held) == 1 else np.concatenate(held)


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): ``nth`` counts within (part, length)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part string, nth long"
    path = path or tokenizer_path()

    def run(batches):
        import uuid

        from lexiquarry.llm import packing  # the module's encoder outlives the task

        words = packing.encoder(path)
        part, seen = uuid.uuid4().hex, np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            out, doc_ids = [], b.column(0).to_pylist()
            for i, ids in packing.encode_texts(words, raw(b.column(1))):
                total = len(ids) + 1  # and the separator
                for k, at in enumerate(range(0, total, capacity)):
                    n = min(capacity, total - at)
                    crc = zlib.crc32(ids[at : at + n])
                    if at + n == total:
                        crc = zlib.crc32(b"\0\0\0\0", crc)
                    out.append((doc_ids[i], k, at, n, crc, part, int(seen[n])))
                    seen[n] += 1
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, run, schema, f"packing {path}")


def plan_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit-decreasing over counts.

    Rows (length, first rank, pieces, first sequence, offset), sorted by (length, first rank).
    """
    rows: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs of sequences (first, number)
    fresh = mask = 0  # bit r of mask: some sequence has exactly r free tokens

    def put(free: int, first: int, n: int) -> None:
        nonlocal mask
        if n and free:
            room.setdefault(free, []).append((first, n))
            mask |= 1 << free

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fits = mask >> length
            if not fits:
                break
            free = length + (fits & -fits).bit_length() - 1  # the smallest room that fits
            first, n = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
            each = min(free // length, max(1, left // n))  # a whole layer at a time
            if left < n:
                put(free, first + left, n - left)
                n, each = left, 1
            for _ in range(each):
                rows.append((length, rank, n, first, capacity - free))
                rank, left, free = rank + n, left - n, free - length
            put(free, first, n)
        per = capacity // length
        whole, rest = divmod(left, per)
        for k in range(per if whole else 0):
            rows.append((length, rank, whole, fresh, k * length))
            rank += whole
        put(capacity - per * length, fresh, whole)
        fresh += whole
        for k in range(rest):
            rows.append((length, rank, 1, fresh, k * length))
            rank += 1
        if rest:
            put(capacity - rest * length, fresh, 1)
            fresh += 1
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(pieces(docs, text, doc_id, capacity, path), "packing-pieces")
    per_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_histogram(counts, capacity)
    if sys.byteorder != "little":  # pragma: no cover
        raise RuntimeError("ids are packed little-endian")
    big = np.int64(1) << 40  # ranks within a length are below 2**40
    keys = plan[:, 0] * big + plan[:, 1]

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            if not len(length):
                continue
            at = np.searchsorted(keys, length * big + rank, side="right") - 1
            row = plan[at]
            seq = row[:, 3] + (rank - row[:, 1])
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(row[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(starts, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return arrow_map(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
