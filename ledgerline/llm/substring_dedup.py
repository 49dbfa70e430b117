"""Substring dedup: remove words covered by a window of ``n`` words that already occurred earlier.

Method: Rabin-Karp hashes of every window of ``n`` consecutive words. Each task hashes its texts with
prefix sums modulo 2**64, keeps the earliest occurrence of a hash among its own texts (the rest are known
repeats), and sends the survivors in packed blocks to the partition that owns the hash range. There all
occurrences of a hash meet, at most one per (slice of input, hash), so a passage that a third of the corpus
shares is no hot key. The number of partitions follows the bytes of the texts, counted first. Every occurrence but the earliest is a repeat; repeated windows return to their
document, where overlapping ones merge into maximal removal intervals.

A window is told by 64 bits of one rolling hash and the partition number drawn from a second,
independent one; two different windows are taken for one with probability below 2**-64 a pair.

Defined cases: a null text has no words. A null id sorts after all others. Rows with the same id and text
are one document and give equal results; rows with one id and different texts are told apart by the text,
and equal (id, start) is not "earlier". Texts of fewer than ``n`` words are kept whole. Other columns pass
through unchanged; a column named like the result is replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import free_name, order_id, partitions_for, text_key, text_of
from ._words import SPACE_SEPARATED, mix, runs, windows, words

WINDOW = 20
SLICE_BYTES = 8 << 20       # text whose windows are in a task's memory at once, unless one text is longer
OWNER_BYTES = 16 << 20      # text behind the windows that one owner partition holds, about 2.7 million windows of 32 bytes
_MARKS, _ENTRIES = 0, 1


def _home(ids: np.ndarray, keys: np.ndarray, parts: int) -> np.ndarray:
    """Partition of a document, by id and text: the rows without an id are spread like any others."""
    return (mix(ids.astype(np.uint64) ^ mix(keys.astype(np.uint64))) % np.uint64(parts)).astype(np.uint32)


def _pack(kind: int, ids: np.ndarray, keys: np.ndarray, pos: np.ndarray, hashes: np.ndarray) -> bytes:
    """One block: entries in (document, position) order; documents run-length coded, positions as steps."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (pos[1:] < pos[:-1])
    at = np.flatnonzero(new)
    step = pos.copy()
    step[1:] -= np.where(new[1:], 0, pos[:-1])
    planes = b"".join((np.diff(ids[at], prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(),
                       keys[at].astype("<i8").tobytes(),
                       np.diff(at, append=len(ids)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(),
                       step.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()))
    small = zstandard.compress(planes, 1)
    return struct.pack("<BIII", kind, len(at), len(ids), len(small)) + small + hashes.astype("<u8").tobytes()


def _unpack(block: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kind, docs, n, size = struct.unpack_from("<BIII", block)
    planes = np.frombuffer(zstandard.decompress(block[13:13 + size]), np.uint8)
    ids = np.ascontiguousarray(planes[:8 * docs].reshape(8, -1).T).view("<i8").ravel().cumsum()
    keys = planes[8 * docs:16 * docs].copy().view("<i8")
    runs_ = np.ascontiguousarray(planes[16 * docs:20 * docs].reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    step = np.ascontiguousarray(planes[20 * docs:].reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    pos = step.cumsum()
    head = runs_.cumsum() - runs_
    pos -= np.repeat(pos[head] - step[head], runs_)
    return kind, np.repeat(ids, runs_), np.repeat(keys, runs_), pos, np.frombuffer(block, "<u8", offset=13 + size)


def _mark_blocks(ids, keys, pos) -> Iterator[tuple[int, int, bytes]]:
    """(id, key, packed starts) for each document of the repeated windows."""
    if not len(ids):
        return
    order = np.lexsort((pos, keys, ids))
    ids, keys, pos = ids[order], keys[order], pos[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    for a, b in zip(at, [*at[1:], len(ids)]):
        yield int(ids[a]), int(keys[a]), np.diff(pos[a:b], prepend=0).astype("<u4").tobytes()


def _earliest(hashes, ids, pos) -> tuple[np.ndarray, np.ndarray]:
    """Order of the entries by (hash, id, position) and, in that order, whether an entry is a repeat."""
    order = np.lexsort((pos, ids, hashes))
    h, i, p = hashes[order], ids[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    return order, (i != i[lead]) | (p != p[lead])


def _blocks(ids_all: np.ndarray, keys_all: np.ndarray, texts: pa.Array, n: int, parts: int) -> list[tuple[int, bytes]]:
    """(owner partition, packed block) of the windows of a slice of texts."""
    cols: list[list[np.ndarray]] = [[], [], [], [], []]
    for lo, hi in runs(texts):
        w = words(texts, SPACE_SEPARATED, lo, hi, nul_is_word=True)
        first, h = windows(w, n, 0)
        _, owner = windows(w, n, 1)
        row = w.doc[first] + lo
        for c, v in zip(cols, (h, ids_all[row], keys_all[row], w.pos[first].astype(np.int64),
                               ((owner >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint32))):
            c.append(v)
        del w
    h, ids, keys, pos, owner = (np.concatenate(c) for c in cols)
    del cols
    rows: list[tuple[int, bytes]] = []
    order, again = _earliest(h, ids, pos)
    repeat, keep = order[again], order[~again]
    del order, again
    for kind, at, to in ((_MARKS, repeat, _home(ids[repeat], keys[repeat], parts)), (_ENTRIES, keep, owner[keep])):
        sort = np.lexsort((pos[at], keys[at], ids[at], to))
        at, to = at[sort], to[sort]
        cut = np.searchsorted(to, np.arange(parts + 1))
        for k in np.unique(to).tolist():
            x = at[cut[k]:cut[k + 1]]
            rows.append((k, _pack(kind, ids[x], keys[x], pos[x], h[x] if kind == _ENTRIES else np.zeros(0, np.uint64))))
    return rows


def _scatter(n: int, parts: int):
    """Arrow task: texts -> packed window blocks, one row a (slice of the batch, owner partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi in runs(batch.column(2), SLICE_BYTES):
                rows = _blocks(ids[lo:hi], keys[lo:hi], batch.column(2).slice(lo, hi - lo), n, parts)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                                      pa.array([r[1] for r in rows], pa.binary())], ["owner", "block"])

    return run


def _meet(parts: int):
    """Arrow task of one owner partition: all occurrences of its hashes -> repeated starts, packed by document partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[list[np.ndarray]] = [[], [], [], []]
        marks: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for block in batch.column("block"):
                kind, *cols = _unpack(block.as_py())
                for c, v in zip(marks if kind == _MARKS else entries, cols):
                    c.append(v)
        if entries[0]:
            ids, keys, pos, h = (np.concatenate(c) for c in entries)
            del entries
            order, again = _earliest(h, ids, pos)
            at = order[again]
            for c, v in zip(marks, (ids[at], keys[at], pos[at])):
                c.append(v)
            del ids, keys, pos, h, order
        if not marks[0]:
            return
        ids, keys, pos = (np.concatenate(c) for c in marks)
        to = _home(ids, keys, parts)
        sort = np.lexsort((pos, keys, ids, to))
        ids, keys, pos, to = ids[sort], keys[sort], pos[sort], to[sort]
        cut = np.searchsorted(to, np.arange(parts + 1))
        for k in np.unique(to).tolist():
            x = slice(cut[k], cut[k + 1])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()),
                                              pa.array([_pack(_MARKS, ids[x], keys[x], pos[x], np.zeros(0, np.uint64))], pa.binary())],
                                             ["owner", "block"])

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task of one document partition: packed repeats -> one row a document."""
    found = [_unpack(block.as_py())[1:4] for batch in batches for block in batch.column("block")]
    if not found:
        return
    rows = list(_mark_blocks(*(np.concatenate(c) for c in zip(*found))))
    for i in range(0, len(rows), 4096):
        part = rows[i:i + 4096]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()),
             pa.array([r[2] for r in part], pa.binary())], ["_rid", "_rkey", "starts"])


def _cut(n: int):
    def cut(text: pa.Array, marks: pa.Array) -> pa.Array:
        n_words, n_removed, kept, spans = [], [], [], []
        for t, blocks in zip(text, marks):
            ws = (t.as_py() or "").encode().split()
            n_words.append(len(ws))
            mine, gone = [], 0
            if blocks.is_valid:
                starts = np.unique(np.frombuffer(blocks.as_py(), "<u4").cumsum(dtype=np.int64))
                delta = np.zeros(len(ws) + 1, np.int32)
                np.add.at(delta, starts, 1)
                np.add.at(delta, starts + n, -1)
                covered = delta.cumsum()[:-1] > 0
                gone = int(covered.sum())
                step = np.diff(covered.astype(np.int8), prepend=0, append=0)
                mine = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]
                ws = [x for x, c in zip(ws, covered.tolist()) if not c]
            n_removed.append(gone)
            kept.append(b" ".join(ws).decode())
            spans.append(mine)
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            ["n_words", "n_removed", "kept_text", "intervals"])

    return F.arrow_udf(cut, "n_words long, n_removed long, kept_text string, intervals array<struct<start int, end int>>")


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """Starts of repeated windows: (_rid, _rkey, starts: packed positions), one row a document that has any."""
    parts = partitions_for(docs, text_col, OWNER_BYTES)
    blocks = (docs.select(order_id(id_col), text_key(text_col), text_of(docs, text_col))
              .mapInArrow(_scatter(n, parts), "owner int, block binary"))
    met = blocks.repartitionById(parts, F.col("owner")).mapInArrow(_meet(parts), "owner int, block binary")
    return met.repartitionById(parts, F.col("owner")).mapInArrow(_gather, "_rid long, _rkey long, starts binary")


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW,
                            out: str = "dedup") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_removed, kept_text (kept words joined by one space) and
    intervals (maximal removed word ranges, end exclusive)."""
    rid, rkey, marks = (free_name(docs, x) for x in ("_rid", "_rkey", "_marks"))
    found = repeated_starts(docs, id_col, text_col, n).toDF(rid, rkey, marks)
    named = docs.withColumns({rid: order_id(id_col), rkey: text_key(text_col)})
    joined = named.join(found, [rid, rkey], "left")
    return joined.withColumn(out, _cut(n)(text_of(docs, text_col), F.col(marks))).drop(rid, rkey, marks)
