"""Line dedup: delete later repeats of runs of lines, by winnowing.

A text's lines (cut at line ends, blanks at the ends ignored, blank lines skipped) are hashed. A run counts if it has ``min_lines`` = 3
lines, or fewer with ``long_words`` = 50 words or more in total. Every line that lies in a counting run which occurs
earlier (smaller document, or same document and earlier line) is deleted.

Method: every counting run of at most three lines is a window, and the line with the least hash in it is its fingerprint, so two
equal windows have the same line as fingerprint: a repeated run cannot be missed. Neighbouring windows mostly
share a fingerprint, so about half of the lines are one. Fingerprints are grouped by line hash first; those of lines that are no
fingerprint elsewhere go at once. The others are keyed by line hash and window (128 bits), so that the first place of a key is a true
partner wherever parts of the window occurred before; joined to that place; and the match is extended both ways, over the window and the
lines on either side that a fingerprint carries. The ranges found merge into runs.

Only the first place of a key meets the others (n - 1 rows for n places, never all pairs), and the two sides of each join are
written tables, so adaptive execution splits the partition of a very common line.

Defined cases: a null text stays null. A null id sorts after all others; of one id, texts are ordered by their hash. Rows with
the same id and text are one document. Blank lines stay unless the line before them was deleted. Texts without a repeated
run are returned unchanged, byte for byte. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._frames import free_name, order_id, stash, text_key, text_of

MIN_LINES, LONG_WORDS = 3, 50
REACH = 1                   # lines on either side that a fingerprint carries beside its windows
_PACKED = 18                # bytes of a window: lines before the fingerprint, lines, 128-bit hash
_SIDES = [f"{side}{k}" for side in ("up", "down") for k in range(1, REACH + 1)]
_FINGERPRINTS = f"line long, id long, key long, pos int, {', '.join(f'{c} long' for c in _SIDES)}, windows binary"


def _hashed(text: str | None) -> tuple[list[bytes], list[int]]:
    """128-bit hash and number of words of each line that is not blank."""
    lines = [x for x in (y.strip() for y in (text or "").split("\n")) if x]
    return [xxhash.xxh3_128_digest(x.encode(), 1) for x in lines], [len(x.split()) for x in lines]


def _windows(hashes: list[bytes], words: list[int], long_words: int, min_lines: int) -> list[tuple[bytes, int, bool, int]]:
    out = []
    for k in range(len(hashes)):
        for size in range(1, min(min_lines, len(hashes) - k + 1)):
            if sum(words[k:k + size]) >= long_words:
                out.append((xxhash.xxh3_128_digest(b"".join(hashes[k:k + size]), 2), k, True, size))
        if k + min_lines <= len(hashes):
            out.append((xxhash.xxh3_128_digest(b"".join(hashes[k:k + min_lines]), 2), k, False, min_lines))
    return out


def fingerprints(text: str | None, long_words: int = LONG_WORDS, min_lines: int = MIN_LINES) -> list[tuple[bytes, int, bool, int]]:
    """(128-bit hash, number of its first line, whether it counts by its words, lines) of each window of one text."""
    return _windows(*_hashed(text), long_words, min_lines)


def winnow(text: str | None, long_words: int = LONG_WORDS, min_lines: int = MIN_LINES) -> tuple[list[bytes], dict[int, list[tuple[bytes, int, int]]]]:
    """(line hashes, {fingerprint's line: its windows as (hash, first line, lines)}): a window's fingerprint is its first line of least hash."""
    hashes, words = _hashed(text)
    chosen: dict[int, list] = {}
    for digest, k, _, size in _windows(hashes, words, long_words, min_lines):
        at = k if size == 1 else min(range(k, k + size), key=hashes.__getitem__)
        chosen.setdefault(at, []).append((digest, k, size))
    return hashes, chosen


def _emit(long_words: int, min_lines: int):
    def first_half(digests: list[bytes]) -> list[int]:
        return np.frombuffer(b"".join(digests), "<i8")[::2].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                row, pos, line, sides, wins = [], [], [], [[] for _ in _SIDES], []
                for i, t in enumerate(part.column(2)):
                    hashes, chosen = winnow(t.as_py(), long_words, min_lines)
                    short = first_half(hashes)
                    padded = [0] * REACH + short + [0] * REACH      # 0: no line there
                    for at, mine in chosen.items():
                        row.append(i)
                        pos.append(at)
                        line.append(short[at])
                        for c, shift in zip(sides, [*range(-1, -REACH - 1, -1), *range(1, REACH + 1)]):
                            c.append(padded[at + REACH + shift])
                        wins.append(b"".join([bytes((at - k, n)) + digest for digest, k, n in mine]))
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(line, pa.int64()), part.column(0).take(at), part.column(1).take(at), pa.array(pos, pa.int32()),
                     *[pa.array(c, pa.int64()) for c in sides], pa.array(wins, pa.binary())],
                    ["line", "id", "key", "pos", *_SIDES, "windows"])

    return run


def _extended(side: str) -> Column:
    """Equal lines next to a match on one side, as far as the fingerprints carry them."""
    count = F.lit(0)
    for k in range(REACH, 0, -1):
        mine = F.col(f"{side}{k}")
        count = F.when((mine != 0) & (mine == F.col(f"s.{side}{k}")), count + 1).otherwise(0)
    return count


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES,
                  long_words: int = LONG_WORDS) -> DataFrame:
    """(id, key, runs): for each document with a later repeat, its ranges of line numbers (end exclusive)."""
    prints = stash(docs.select(order_id(id_col), text_key(text_col), text_of(docs, text_col)).mapInArrow(_emit(long_words, min_lines), _FINGERPRINTS))
    several = stash(prints.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("line"))
    keyed = prints.join(several, "line", "left_semi").select("*", F.explode(F.sequence(F.lit(0), F.length("windows") - _PACKED, F.lit(_PACKED))).alias("at"))
    byte = lambda k: F.conv(F.hex(F.substring("windows", F.col("at") + k, F.lit(1))), 16, 10).cast("int")
    keyed = stash(keyed.select(F.substring("windows", F.col("at") + 3, F.lit(16)).alias("window"), "id", "key", (F.col("pos") - byte(1)).alias("a"),
                               byte(2).alias("n"), "pos", *_SIDES))
    place = ["id", "key", "a"]
    first = stash(keyed.groupBy("window").agg(F.min(F.struct(*place, "pos", *_SIDES)).alias("s"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    later = keyed.join(first, "window").where(F.struct(*place) > F.struct(*[F.col(f"s.{c}") for c in place]))
    start = F.least("a", F.col("pos") - _extended("up"))
    end = F.greatest(F.col("a") + F.col("n"), F.col("pos") + 1 + _extended("down"))
    runs = later.select("id", "key", F.struct(start.alias("a"), end.alias("b")).alias("r"))
    return runs.groupBy("id", "key").agg(F.collect_set("r").alias("runs"))  # bounded by the document's own lines


def _cut(text: pa.Array, runs: pa.Array) -> pa.Array:
    kept, total, removed = [], [], []
    for t, r in zip(text, runs):
        raw = t.as_py()
        lines = (raw or "").split("\n")
        gone, n = set(), sum(1 for x in lines if x.strip())
        for x in r.as_py() or ():
            gone.update(range(x["a"], x["b"]))
        total.append(n)
        removed.append(len(gone))
        if gone:
            out, number, last = [], -1, False
            for x in lines:
                if x.strip():
                    number += 1
                    last = number in gone
                if not last:
                    out.append(x)
            raw = "\n".join(out)
        kept.append(raw)
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
                                      ["kept_text", "n_lines", "n_removed"])


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "line_dedup", **options) -> DataFrame:
    """``docs`` with a struct column ``out``: kept_text, n_lines (lines that are not blank) and n_removed of them."""
    rid, rkey, runs = (free_name(docs, x) for x in ("_rid", "_rkey", "_runs"))
    found = repeated_runs(docs, id_col, text_col, **options).toDF(rid, rkey, runs)
    named = docs.withColumns({rid: order_id(id_col), rkey: text_key(text_col)})
    cut = F.arrow_udf(_cut, "kept_text string, n_lines long, n_removed long")
    return named.join(found, [rid, rkey], "left").withColumn(out, cut(text_of(docs, text_col), F.col(runs))).drop(rid, rkey, runs)
