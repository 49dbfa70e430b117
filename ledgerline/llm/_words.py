"""Vectorised word boundaries and rolling (Rabin-Karp) hashes over Arrow string arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000         # texts are hashed in runs of about this size to bound memory
_BYTE_BASE = 0x9E3779B97F4A7C15
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply and xor-shift rounds)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    out = np.full(size, b, _U64)
                    out[0] = 1
                    setattr(self, name, np.multiply.accumulate(out))
        return self.up[:n], self.down[:n]


_BYTE_POWERS = _Powers(_BYTE_BASE)
_WINDOW_POWERS = tuple(_Powers(b) for b in WINDOW_BASES)
_BYTE_CODES = mix(np.arange(1, 257, dtype=_U64) * _U64(0x2545F4914F6CDD1D))

# Byte classes: 0 marks a byte that separates words, anything else is the byte as it counts.
SPACE_SEPARATED = np.arange(256, dtype=np.uint8)
SPACE_SEPARATED[[0x20, *range(0x09, 0x0E)]] = 0
ALNUM_LOWER = np.arange(256, dtype=np.uint8)
ALNUM_LOWER[ord("A"):ord("Z") + 1] += 32
ALNUM_LOWER[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0


@dataclass
class Words:
    """Words of a run of texts: ``doc`` is each word's text (index in the run), ``pos`` its place there."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    pos: np.ndarray
    hash: np.ndarray
    per_doc: np.ndarray


def _buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (n + 1) and bytes of a string array; null texts have no bytes."""
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    offsets = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1] \
        if len(arr) else np.zeros(1, np.int64)
    raw = arr.buffers()[2] if len(arr) else None
    return offsets.astype(np.int64), np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)


def runs(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (first, last + 1) ranges of texts of about ``limit`` bytes; a longer text is a run of its own."""
    offsets, _ = _buffers(arr)
    i, n = 0, len(arr)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def words(arr: pa.Array, classes: np.ndarray, first: int, last: int, nul_is_word: bool = False) -> Words:
    """Words of ``arr[first:last]`` under a byte class table, each with a 64-bit hash of its bytes.

    ``nul_is_word``: the byte 0 belongs to words although its class entry is 0.
    """
    offsets, data = _buffers(arr)
    lo, hi = int(offsets[first]), int(offsets[last])
    data, bounds = data[lo:hi], offsets[first:last + 1] - lo
    norm = classes[data]
    inside = norm != 0
    if nul_is_word:
        inside |= data == 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    opens[heads] = inside[heads]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    tails = bounds[1:][bounds[1:] > 0] - 1
    closes[tails] = inside[tails]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _BYTE_POWERS.upto(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, _U64)
        np.cumsum(_BYTE_CODES[norm] * up[:len(data)], out=total[1:])
        hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(_U64))
    doc = np.searchsorted(bounds, start, "right") - 1
    per_doc = np.bincount(doc, minlength=last - first)
    before = np.cumsum(per_doc) - per_doc
    return Words(norm, start, end, doc, np.arange(len(start)) - before[doc], hashes, per_doc)


def windows(w: Words, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, Rabin-Karp hash) of every window of ``n`` words that lies in one text."""
    count = len(w.hash)
    if count < n:
        return np.zeros(0, np.int64), np.zeros(0, _U64)
    up, down = _WINDOW_POWERS[which].upto(count + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(count + 1, _U64)
        np.cumsum(w.hash * up[:count], out=total[1:])
        first = np.flatnonzero(w.pos <= w.per_doc[w.doc] - n)
        return first, mix((total[first + n] - total[first]) * down[first])
