"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Method: bounded-space online best-fit. Each task keeps at most ``open_bins`` open bins in a bitset keyed by free space;
a piece goes into the fullest bin that still holds it (the lowest set bit at or above its length), else into a new bin; when
too many are open the fullest one closes. Pieces reach the tasks by a hash of their row, longest first
inside a task, in tasks of about ``task_pieces`` pieces whatever the size of the input.

Token ids are those of the given ``tokenizers`` file (byte-level BPE), without added special tokens,
followed by ``end_id``. Ids come from the same vocabulary through the tiktoken library, a whole text a call; long texts and very long
runs of white space are cut as in byte_bpe.py. tests/llm hold the ids against the ``tokenizers`` library itself.

Defined cases: a null text is an empty one, which is the one-token piece [end_id]. Only documents of more than ``capacity``
tokens are cut: the first piece takes the remainder, the others are full. Repeated rows are packed each.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._frames import bounded_batches, stash, text_of
from .byte_bpe import SLICE, slices

CAPACITY, END_ID = 2048, 0
OPEN_BINS = 1 << 16
TASK_PIECES = 100_000
_encoders: dict[str, tuple[tiktoken.Encoding, re.Pattern]] = {}


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes a byte as a letter: printable Latin-1 bytes as themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str) -> tuple[tiktoken.Encoding, re.Pattern]:
    """Encoder of a byte-level BPE ``tokenizers`` file and what splits a text at its special tokens, once a process."""
    if path not in _encoders:
        import public_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = _byte_letters()
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        enc = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        longest_first = sorted(special, key=len, reverse=True)
        _encoders[path] = enc, re.compile(f"({'|'.join(map(re.escape, longest_first)) or '(?!)'})")
    return _encoders[path]


def encode(path: str, text: str, size: int = SLICE) -> bytes:
    """Token ids of one text as little-endian unsigned 32-bit integers.

    What lies between special tokens is encoded apart, as the ``tokenizers`` library does, in slices of about ``size`` characters.
    """
    enc, special = encoder(path)
    ids = []
    for k, span in enumerate(special.split(text)):
        if k % 2:
            ids.append([enc.encode_single_token(span)])
            continue
        for part, single in slices(span, size):
            ids.append(enc._encode_single_piece(part) if single else enc.encode_to_numpy(part, disallowed_special=()))
    return b"".join([np.asarray(x, "<u4").tobytes() for x in ids])


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``id_col``, piece, start, length, ids (packed unsigned 32-bit integers)."""

    def cut(text: pa.Array) -> pa.Array:
        tail = np.array([end_id], "<u4").tobytes()
        out = []
        for t in text:
            ids = encode(tokenizer_path, t.as_py() or "") + tail
            n = len(ids) // 4
            first = n - capacity * ((n - 1) // capacity)
            edges = [0, *range(first, n + 1, capacity)]
            out.append([{"piece": k, "start": a, "length": b - a, "ids": ids[4 * a:4 * b]} for k, (a, b) in enumerate(zip(edges, edges[1:]))])
        kind = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        return pa.array(out, pa.list_(kind))

    pieces = F.arrow_udf(cut, "array<struct<piece int, start long, length long, ids binary>>")
    return docs.select(F.col(id_col), F.explode(pieces(text_of(docs, text_col))).alias("p")).select(id_col, "p.*")


class BestFit:
    """Open bins in a bitset by free space; ``place`` returns (bin number, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most, self.open, self.count = capacity, open_bins, 0, 0
        self.bits = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.count
            self.count += 1
        left = free - length
        if left:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """``pieces`` (any columns, with a ``length`` of at most ``capacity``) plus sequence_id and offset."""
    bounded_batches(pieces.sparkSession)
    pieces = stash(pieces)
    tasks = max(1, math.ceil(pieces.count() / task_pieces))
    more = [StructField("sequence_id", LongType()), StructField("offset", LongType())]
    schema = StructType([*(f for f in pieces.schema.fields), *more])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for b in batches:
            placed = [bins.place(n) for n in b.column("length").to_pylist()]
            where = [pa.array([base + p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *where], schema.names)

    every = [F.col(f"`{c}`") for c in pieces.columns]
    return pieces.repartition(tasks, *every).sortWithinPartitions(F.col("length").desc(), *every).mapInArrow(fit, schema)
