"""Byte-level BPE encoding and decoding with the tiktoken library and a rank file given by path.

Method: the rank file is read where the work is done, once a worker. Short texts go to the library whole. Long ones are first cut by
regular expressions at safe boundaries, places where the split pattern ends a match whatever stands around them: before a run of
white space that follows another character, and between an ASCII letter and an ASCII digit. Every slice is encoded alone, so what the
library holds at once follows ``SLICE`` and not the text; a match without such a place inside (one long word) stays whole.
The library's pattern engine overflows its stack on very long runs of white space: from ``LONG_RUN`` characters on, the run's match
(all of it at the end of a text, else all but the last character) is handed to the merges directly. Ids equal those of the library on
the whole text wherever it can encode that. Decoding joins the raw bytes of the ids, so it is exact for any text.

The pattern must be one that never joins white space to the character before it nor ASCII letters to digits, as the patterns of
public byte-level vocabularies do.

Defined cases: a null text is an empty one and has no ids; strings of special tokens are ordinary text. Ids that are null or not in the
vocabulary make the whole row's bytes null; a null list of ids has no bytes. Repeated rows each get a row.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import bounded_batches, text_of

SLICE = 1 << 16
LONG_RUN = 1000
# The Unicode property White_Space, as the pattern's \s has it.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SAFE = re.compile(rf"[^{WHITE_SPACE}](?=[{WHITE_SPACE}])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
_RUN = re.compile(rf"[{WHITE_SPACE}]{{{LONG_RUN},}}")
_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The library's encoding of a rank file (base64 token, blank, rank a line), once a process."""
    key = ranks_path, pattern
    if key not in _encodings:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        _encodings[key] = tiktoken.Encoding(ranks_path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def slices(text: str, size: int = SLICE) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one match already) of a text, in order; the parts join to the text."""
    at = 0
    for run in [*_RUN.finditer(text), None]:
        stop = run.start() if run else len(text)
        while at < stop:
            cut = _SAFE.search(text, at + size - 1, stop) if stop - at > size else None
            end = cut.end() if cut else stop
            yield text[at:end], False
            at = end
        if run:
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield text[run.start():at], True


def encode(enc: tiktoken.Encoding, text: str, size: int = SLICE) -> np.ndarray:
    """Ids of one text."""
    if len(text) < min(size, LONG_RUN):
        return np.array(enc.encode_ordinary(text), np.int32)
    parts = [enc._encode_single_piece(part) if single else enc.encode_ordinary(part) for part, single in slices(text, size)]
    return np.concatenate([np.array(p, np.int32) for p in parts])


def decode(enc: tiktoken.Encoding, ids: list[int | None]) -> bytes | None:
    """Raw bytes of ids; None where one of them is no id of the vocabulary."""
    try:
        return enc.decode_bytes(ids)
    except (KeyError, OverflowError, TypeError):
        return None


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "ids", size: int = SLICE) -> DataFrame:
    """``docs`` plus ``out``: the ids (array of int) of each whole text."""

    def ids(text: pa.Array) -> pa.Array:
        enc = encoding(ranks_path, pattern)
        each = [encode(enc, t.as_py() or "", size) for t in text]
        ends = np.cumsum([0, *map(len, each)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *each])))

    # not deterministic in name only: Spark then keeps it apart from a decoder that reads it, and encodes once
    return docs.withColumn(out, F.arrow_udf(ids, "array<int>").asNondeterministic()(text_of(docs, text_col)))


def decode_ids(rows: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """``rows`` plus ``out``: the bytes that the ids stand for."""
    bounded_batches(rows.sparkSession)

    def raw(ids: pa.Array) -> pa.Array:
        enc = encoding(ranks_path, pattern)
        flat, ends = ids.values.to_pylist() if ids.values.null_count else ids.values.to_numpy().tolist(), ids.offsets.to_pylist()
        known = [] if not len(ids) else ids.is_valid().to_pylist()
        return pa.array([decode(enc, flat[a:b]) if ok else b"" for a, b, ok in zip(ends, ends[1:], known)], pa.binary())

    return rows.withColumn(out, F.arrow_udf(raw, "binary")(F.col(ids_col)))
