"""Benchmark decontamination: find the word windows of test items in training texts.

Method: both sides are normalised alike (A-Z lower-cased; words are runs of other letters, digits and
non-ASCII characters). Every window of ``n`` consecutive words of an item goes into a hash set that is broadcast;
an item of fewer words is one window of its own length. Tasks scan the windows of whole texts with rolling hashes;
a hash hit counts only after its words equal the item's words. Each word inside any occurrence is hit.

Only a benchmark of proven size is broadcast: its bytes are summed first, and beyond ``broadcast_bytes``
the windows are joined by hash in a shuffle instead (``_hits_by_join``), with the same result.

Defined cases: a null text (on either side) has no words; an item without words matches nothing; a null
item id is kept out of the list of items but its windows still hit. Repeated items and rows count as they are (items as a set of ids).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import free_name, text_of
from ._words import ALNUM_LOWER, Words, runs, windows, words

WINDOW = 10
BROADCAST_BYTES = 64 << 20
_FILTER_BITS = 20
_TYPE = "n_words long, n_hit long, items array<string>, spans array<struct<start int, end int>>"


def _phrase(w: Words, first: int, n: int) -> bytes:
    """The ``n`` normalised words from word ``first`` on, one space between."""
    return b" ".join(w.data[w.start[k]:w.end[k]].tobytes() for k in range(first, first + n))


def _item_windows(arr: pa.Array, n: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, length, hash, words) of every window of the items in ``arr``."""
    for lo, hi in runs(arr):
        w = words(arr, ALNUM_LOWER, lo, hi)
        lengths = {n} | {int(x) for x in np.unique(w.per_doc) if 0 < x < n}
        for length in sorted(lengths):
            first, h = windows(w, length)
            for k, x in zip(first.tolist(), h.tolist()):
                if length == n or w.per_doc[w.doc[k]] == length:
                    yield lo + int(w.doc[k]), length, x, _phrase(w, k, length)


class _Index:
    """Hash set of the windows, by length: sorted hashes, a bit filter before them, and the words behind them."""

    def __init__(self, rows: list[tuple[str | None, int, int, bytes]]):
        self.phrases: dict[tuple[int, int], dict[bytes, set[str]]] = {}
        for item, length, h, phrase in rows:
            items = self.phrases.setdefault((length, h), {}).setdefault(phrase, set())
            if item is not None:
                items.add(item)
        self.hashes = {}
        for length in sorted({k[0] for k in self.phrases}):
            known = np.array(sorted(h for l, h in self.phrases if l == length), np.uint64)
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(known & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
            self.hashes[length] = known, bits

    def hits(self, w: Words) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, length, items) of every verified occurrence in a run of texts."""
        for length, (known, bits) in self.hashes.items():
            first, h = windows(w, length)
            may = np.flatnonzero(bits[(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            at = np.searchsorted(known, h[may])
            at[at == len(known)] = 0
            for k in may[known[at] == h[may]].tolist():
                items = self.phrases[length, int(h[k])].get(_phrase(w, int(first[k]), length))
                if items is not None:
                    yield int(first[k]), length, items


def _results(w: Words, hits: list[tuple[int, int, set[str]]]) -> Iterator[tuple[int, int, list, list]]:
    """One result a text of the run."""
    edge = np.zeros(len(w.hash) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for k, length, found in hits:
        edge[k] += 1
        edge[k + length] -= 1
        items.setdefault(int(w.doc[k]), set()).update(found)
    covered = edge.cumsum()[:-1] > 0
    ends = np.cumsum(w.per_doc)
    for d, (b, size) in enumerate(zip(ends.tolist(), w.per_doc.tolist())):
        if d not in items and not covered[b - size:b].any():
            yield size, 0, [], []
            continue
        mine = covered[b - size:b]
        step = np.diff(mine.astype(np.int8), prepend=0, append=0)
        yield size, int(mine.sum()), sorted(items.get(d, ())), [
            {"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]


def _struct(rows: list[tuple]) -> pa.Array:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.StructArray.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], span)],
        ["n_words", "n_hit", "items", "spans"])


def _scanner(shared):
    def scan(text: pa.Array) -> pa.Array:
        index, rows = shared.value, []
        for lo, hi in runs(text):
            w = words(text, ALNUM_LOWER, lo, hi)
            rows += _results(w, list(index.hits(w)))
        return _struct(rows)

    return F.arrow_udf(scan, _TYPE)


def _items_table(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(item, length, hash, words): every window of every item."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [(ids[r], length, h, p) for r, length, h, p in _item_windows(b.column(1), n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array(np.array([r[2] for r in rows], np.uint64).view(np.int64)), pa.array([r[3] for r in rows], pa.binary())],
                ["item", "length", "hash", "words"])

    return benchmark.select(F.col(id_col).cast("string"), text_of(benchmark, text_col)) \
        .mapInArrow(expand, "item string, length int, hash long, words binary").distinct()


def _hits_by_join(docs: DataFrame, text_col: str, items: DataFrame, out: str, n: int) -> DataFrame:
    """The way for a benchmark that is too large to broadcast: windows of the distinct texts join the items' windows by
    (length, hash, words); the verified hits return to the rows by the text's 256-bit digest."""
    lengths = [r.length for r in items.select("length").distinct().collect()]  # at most n rows

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0)
            for lo, hi in runs(b.column(1), 256 << 10):
                w = words(b.column(1), ALNUM_LOWER, lo, hi)
                for length in lengths:
                    first, h = windows(w, length)
                    yield pa.RecordBatch.from_arrays(
                        [key.take(pa.array(w.doc[first] + lo)), pa.array(w.pos[first].astype(np.int32)),
                         pa.array(np.full(len(first), length, np.int32)), pa.array(h.view(np.int64)),
                         pa.array([_phrase(w, k, length) for k in first.tolist()], pa.binary())],
                        ["key", "first", "length", "hash", "words"])

    def merge(text: pa.Array, hits: pa.Array) -> pa.Array:
        rows = []
        for k in range(len(text)):
            w = words(text.slice(k, 1), ALNUM_LOWER, 0, 1)
            mine = [(h["first"], h["length"], set(h["items"])) for h in (hits[k].as_py() or [])]
            rows += _results(w, mine)
        return _struct(rows)

    key, hits = free_name(docs, "_text_key"), free_name(docs, "_hits")
    digest = F.sha2(text_of(docs, text_col), 256)
    texts = docs.select(digest.alias("key"), text_of(docs, text_col).alias("text")).where("text IS NOT NULL").dropDuplicates(["key"])
    grams = items.groupBy("length", "hash", "words").agg(F.collect_set("item").alias("items"))
    found = (texts.mapInArrow(explode, "key string, first int, length int, hash long, words binary")
             .join(grams, ["length", "hash", "words"])
             .groupBy("key").agg(F.collect_list(F.struct("first", "length", "items")).alias(hits))
             .withColumnRenamed("key", key))
    joined = docs.withColumn(key, digest).join(found, key, "left")
    return joined.withColumn(out, F.arrow_udf(merge, _TYPE)(text_of(docs, text_col), F.col(hits))).drop(key, hits)


def _broadcast(benchmark: DataFrame, item_col: str, item_text_col: str, n: int, most: int):
    """The index as a broadcast, or None if the benchmark may need more than ``most`` bytes."""
    size = benchmark.agg(F.sum(F.octet_length(text_of(benchmark, item_text_col)))).first()[0] or 0
    if size * n > most:  # each byte of an item lies in at most n windows
        return None
    rows = [(r.item, r.length, r.hash & (1 << 64) - 1, bytes(r.words)) for r in _items_table(benchmark, item_col, item_text_col, n).toLocalIterator()]
    return benchmark.sparkSession.sparkContext.broadcast(_Index(rows))


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", n: int = WINDOW, out: str = "contamination",
                       broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit (hit words), items (ids of the items found, sorted) and
    spans (maximal ranges of hit words, end exclusive)."""
    shared = _broadcast(benchmark, item_col, item_text_col, n, broadcast_bytes)
    if shared is None:
        return _hits_by_join(docs, text_col, _items_table(benchmark, item_col, item_text_col, n), out, n)
    return docs.withColumn(out, _scanner(shared)(text_of(docs, text_col)))


def _without(text: pa.Array, spans: list[list[dict]]) -> list[str | None]:
    """Texts without the words of ``spans``; what separated a removed range from the text before it stays, what lies inside goes."""
    out = []
    for t, ranges in zip(text, spans):
        raw = t.as_py()
        if raw is not None and ranges:
            w = words(pa.array([raw]), ALNUM_LOWER, 0, 1)
            data, parts, at = raw.encode(), [], 0
            for c in ranges:
                parts.append(data[at:w.start[c["start"]]])
                at = int(w.end[c["end"] - 1])
            raw = b"".join([*parts, data[at:]]).decode()
        out.append(raw)
    return out


def _cleaner(shared):
    """Scan and cut in one function, so that a task holds one Python worker: n_words, n_hit and the clean text."""
    def clean(text: pa.Array) -> pa.Array:
        rows = []
        for lo, hi in runs(text):
            w = words(text, ALNUM_LOWER, lo, hi)
            found = list(_results(w, list(shared.value.hits(w))))
            rows += [(r[0], r[1], t) for r, t in zip(found, _without(text.slice(lo, hi - lo), [r[3] for r in found]))]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2] for r in rows], pa.string())], ["n_words", "n_hit", "text"])

    # not declared deterministic, or the filter on its result would be pushed below it and scan each text a second time
    return F.arrow_udf(clean, "n_words long, n_hit long, text string").asNondeterministic()


def _cut_marked(text: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array(_without(text, spans.to_pylist()), pa.string())


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                         item_text_col: str = "text", n: int = WINDOW, max_share: float = 0.5,
                         broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without contamination, columns unchanged: a text with more than ``max_share`` of its words hit goes,
    and from the others the hit words go. Clean texts stay as they are."""
    out = free_name(docs, "_contamination")
    shared = _broadcast(benchmark, item_col, item_text_col, n, broadcast_bytes)
    if shared is None:
        marked = mark_contamination(docs, benchmark, text_col, item_col, item_text_col, n, out, broadcast_bytes)
        clean = F.arrow_udf(_cut_marked, "string")(text_of(docs, text_col), F.col(f"{out}.spans"))
    else:
        marked = docs.withColumn(out, _cleaner(shared)(text_of(docs, text_col)))
        clean = F.col(f"{out}.text")
    kept = marked.where(F.col(f"{out}.n_hit") <= F.col(f"{out}.n_words") * max_share)
    return kept.withColumn(text_col, F.when(F.col(f"{out}.n_hit") > 0, clean).otherwise(F.col(text_col))).drop(out)
