"""Byte-level word primitives shared by the Arrow operators.

A word is a maximal run outside ``[\\x20\\x09-\\x0D]``: exactly what ``bytes.split()`` yields on UTF-8.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import xxhash

#: Distinct words a worker remembers; past it the memory is dropped and refilled.
CACHE_WORDS = 400_000

U = np.uint64
_MULT = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=U,
)


#: What an operator keeps in a worker process from task to task: owner -> object.
KEPT: dict[str, object] = {}


def keep_only(owner: str | None) -> None:
    """Free what other operators kept in this worker process."""
    for k in [k for k in KEPT if k != owner]:
        del KEPT[k]
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # freed heap goes back to the system
        trim(0)


class Memo(dict):
    """word -> value with a bounded number of remembered words."""

    def __init__(self, fn, limit: int = CACHE_WORDS):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(key) > 64:  # long words are not worth the memory
            return self.fn(key)
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping multiply and shift)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xA0761D6478BD642F)
    return x ^ (x >> U(29))


def word_hashes(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=U, count=len(words))


def word_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` successive words."""
    n = len(h) - k + 1
    out = h[:n] * _MULT[0]
    for i in range(1, k):
        out += h[i : i + n] * _MULT[i]
    return mix(out)


def shingle_set(text: bytes, memo: Memo, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of A-Z-lower-cased ``text``.

    Fewer than ``k`` words make one shingle of the whole sequence; no word makes the empty set.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=U)
    h = word_hashes(words, memo)
    if len(words) < k:
        return mix(np.array([int((h * _MULT[: len(h)]).sum(dtype=U)) ^ (len(h) * 0x1F123BB5 << 20)], dtype=U))
    s = np.sort(windows(h, k))
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()
