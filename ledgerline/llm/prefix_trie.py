"""Prefix trie of conversations: one row per distinct sequence of first turns, built as a distributed burst trie.

A turn is the pair (role, text), known by 16 bytes of a SHA-256; a conversation is the string of its turn ids. Equal conversations are
counted first and travel as one path, whatever their number. Then:

* All paths hang in one container under the root. A container of more than ``limit`` turns and several paths bursts: its head takes the
  turns that all its paths share (found from the least and the greatest path, so a long common opening bursts at once), and
  its paths go on to new containers by their next turn id. Rounds go on until no container is oversized; only paths of
  oversized ones are written again. ``limit`` is at least a ``MAX_HEADS``-th of all turns, so a round has at most ``MAX_HEADS``
  heads: that bounds what is broadcast.
* The remaining containers are dealt to tasks by their head, sorted, and swept: each path opens nodes behind what it shares with the
  one before it, and sums go from the last opened node to the first. A task holds one container at a time.
* Heads add up their containers, from the deepest round to the root.

The digest of a node's own conversations takes their ids in blocks of ``BLOCK`` consecutive numbers, each joined in Spark, and streams
the blocks, so a group of copies of any size is never held.

Bounds: a conversation's ids (16 bytes a turn) and word counts (4 bytes) form one row, and a path alone in its container is
swept by one task, whatever its length.

Defined cases: rows without a conversation id belong to no conversation; NULL roles and texts are empty; a conversation without turns ends
at the root; no conversations, no nodes. Repeated conversations count each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import sequence
from ._frames import bounded_batches, stash
from .turns import decimal_crc, digest

ID = 16                  # bytes of a turn id
LIMIT = 1 << 16          # turns of a container that need not burst
MAX_HEADS = 2000
BLOCK = 1 << 16
EMIT = 1 << 13
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_SUMS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_NODES = "cid binary, parent binary, top boolean, " + ", ".join(f"{c} long" for c in _SUMS) + ", ends_sha256 string"


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn_id, words of ``turns`` (conv_id, turn, role, text): by turn, NULL first, rows of one turn by role
    and turn id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), digest("role", "text").alias("turn_id"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).alias("words"))
    return sequence(rows, ["conv_id"], [F.col("turn"), F.col("role"), F.col("turn_id")], "place").select("conv_id", "place", "turn_id", "words")


def branched(numbered: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversation ids) rebuilt as branches: the first h turns of conversation c - c % ``every``, then c's own turns after its
    first h, where h is the CRC-32 of c modulo ``most``."""
    convs = numbered.select("conv_id").distinct()
    taken = (decimal_crc(F.col("conv_id")) % most).alias("h")
    own = numbered.where(F.col("place") > decimal_crc(F.col("conv_id")) % most)
    base = numbered.where((F.col("conv_id") % every == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    lent = convs.select("conv_id", taken, (F.col("conv_id") - F.col("conv_id") % every).alias("base")).join(base, "base")
    lent = lent.where(F.col("place") <= F.col("h"))
    return own.unionByName(lent.select(*own.columns)), convs


def _paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, ids (turn ids in a row), words (a number a turn), key (16 bytes of ids' digest)."""
    one = F.struct("place", "turn_id", "words")
    rows = turns.select("conv_id", one.alias("t")).unionByName(convs.select("conv_id", F.lit(None).cast(turns.select(one.alias("t")).schema["t"].dataType).alias("t")))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    ids = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x.turn_id)), ""))
    return got.select("conv_id", ids.alias("ids"), F.col("t.words").alias("words"), _key(ids).alias("key"))


def _key(ids: Column) -> Column:
    return F.substring(F.unhex(F.sha2(ids, 256)), 1, ID)


def _first_turns(ids: Column, n: Column) -> Column:
    return F.substring(ids, F.lit(1), (n * ID).cast("int"))


def _ends(paths: DataFrame) -> DataFrame:
    """key, ends_sha256: the digest of the ascending decimal ids of the conversations that are the path."""
    blocks = paths.groupBy("key", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            keys, shas = [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        shas.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])

    near = blocks.repartition("key").sortWithinPartitions("key", "block")
    return near.select("key", "text").mapInArrow(hashed, "key binary, ends_sha256 string")


def _shared_turns(a: Column, b: Column) -> Column:
    """Number of turns that two paths have in common at their start, by halving steps."""
    most = F.floor(F.least(F.length(a), F.length(b)) / ID).cast("int")
    steps = F.array(*[F.lit(1 << i) for i in range(26, -1, -1)])
    return F.reduce(steps, F.lit(0), lambda n, s: F.when((n + s <= most) & (_first_turns(a, n + s) == _first_turns(b, n + s)), n + s).otherwise(n))


def _shared(a: bytes, b: bytes, least: int) -> int:
    n, most = least, min(len(a), len(b)) // ID
    while n < most and a[ID * n:ID * n + ID] == b[ID * n:ID * n + ID]:
        n += 1
    return n


class _Container:
    """Nodes of one container in the order in which its sorted paths open them."""

    def __init__(self, depth: int):
        self.first, self.last = depth, b""
        self.stack: list[int] = []                      # open nodes, by depth from ``first``
        self.conv, self.n, self.depth, self.up, self.words, self.ends = [], [], [], [], [], []

    def add(self, ids: bytes, words: list[int], n: int, conv: int, ends: str) -> None:
        depth, length = _shared(self.last, ids, self.first) if self.stack else self.first - 1, len(ids) // ID
        del self.stack[depth - self.first + 1:]
        for d in range(depth + 1, length + 1):
            self.up.append(self.stack[-1] if self.stack else -1)
            self.stack.append(len(self.n))
            self.n.append(0)
            self.conv.append(conv)
            self.depth.append(d)
            self.words.append(words[d - 1] if d else 0)
            self.ends.append(_NO_ENDS)
        end = self.stack[-1]
        self.n[end], self.ends[end], self.conv[end], self.last = n, ends, min(conv, self.conv[end]), ids

    def nodes(self, cid: bytes, parent: bytes | None, parent_conv: int | None) -> list[tuple]:
        size = len(self.n)
        children, leaves, saved = [0] * size, [0] * size, [0] * size
        for i in range(size - 1, -1, -1):
            leaves[i] = leaves[i] or 1
            saved[i] += (self.n[i] - 1) * self.words[i]
            p = self.up[i]
            if p >= 0:
                self.n[p] += self.n[i]
                self.conv[p] = min(self.conv[p], self.conv[i])
                children[p] += 1
                leaves[p] += leaves[i]
                saved[p] += saved[i]
        over = [self.conv[p] if p >= 0 else parent_conv for p in self.up]
        return list(zip([cid] * size, [parent] * size, [p < 0 for p in self.up], self.conv, self.depth, over, self.n, children, leaves, saved, self.ends))


def _swept(paths: DataFrame) -> DataFrame:
    """Nodes of whole containers (cid, parent, parent_conv, depth, ids, words, n, conv_id, ends)."""
    kinds = [pa.binary(), pa.binary(), pa.bool_(), *[pa.int64()] * len(_SUMS), pa.string()]
    names = ["cid", "parent", "top", *_SUMS, "ends_sha256"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, box, head = [], None, (None, None, None)

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for cid, parent, above, depth, ids, words, n, conv, ends in zip(*(c.to_pylist() for c in b.columns)):
                if box is None or cid != head[0]:
                    if box is not None:
                        out += box.nodes(*head)
                    box, head = _Container(depth), (cid, parent, above)
                    for i in range(0, len(out) - EMIT, EMIT):
                        yield made(out[i:i + EMIT])
                    out = out[max(0, (len(out) - 1) // EMIT * EMIT):] if len(out) > EMIT else out
                box.add(ids, words, n, conv, ends)
        if box is not None:
            out += box.nodes(*head)
        for i in range(0, len(out), EMIT):
            yield made(out[i:i + EMIT])

    near = paths.repartition("cid").sortWithinPartitions("cid", "ids")
    return near.select("cid", "parent", "parent_conv", "depth", "ids", "words", "n", "conv_id", "ends").mapInArrow(sweep, _NODES)


def prefix_trie(turns: DataFrame, convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Nodes of the trie over ``turns`` (conv_id, place, turn_id, words) of the conversations ``convs`` (conv_id, once each): conv_id (the
    least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    bounded_batches(turns.sparkSession)
    paths = stash(_paths(turns, convs))
    once = paths.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.min_by(F.struct("ids", "words"), "conv_id").alias("p"))
    hung = once.join(_ends(paths), "key").select(
        _key(F.lit(b"")).alias("cid"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("parent_conv"), F.lit(0).alias("depth"),
        "p.ids", "p.words", "n", "conv_id", F.col("ends_sha256").alias("ends"))
    hung = stash(hung)
    every = hung.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    limit = max(limit, -(-every // MAX_HEADS))
    whole, heads = [], []
    while True:
        sizes = hung.groupBy("cid").agg(F.count(F.lit(1)).alias("c"), F.sum(F.size("words") + 1 - F.col("depth")).alias("t"))
        big = stash(sizes.where((F.col("c") > 1) & (F.col("t") > limit)).select("cid"))
        if big.isEmpty():
            whole.append(hung)
            break
        whole.append(hung.join(F.broadcast(big), "cid", "left_anti"))
        inside = hung.join(F.broadcast(big), "cid")
        head = inside.groupBy("cid").agg(
            F.min("ids").alias("lo"), F.max("ids").alias("hi"), F.min_by("words", "ids").alias("w"), F.min_by("ends", "ids").alias("e"), F.sum("n").alias("n"),
            F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in ("depth", "parent", "parent_conv")])
        head = head.withColumn("last", _shared_turns(F.col("lo"), F.col("hi")))
        head = stash(head.select(
            "cid", "parent", "parent_conv", "depth", "last", "n", "conv_id",
            F.slice(F.concat(F.array(F.lit(0)), "w"), F.col("depth") + 1, F.col("last") - F.col("depth") + 1).alias("words"),
            F.when(F.length("lo") == F.col("last") * ID, F.col("e")).otherwise(_NO_ENDS).alias("ends")))
        heads.append(head)
        on = inside.join(F.broadcast(head.select("cid", "last", F.col("conv_id").alias("head_conv"))), "cid").where(F.length("ids") > F.col("last") * ID)
        hung = stash(on.select(_key(_first_turns(F.col("ids"), F.col("last") + 1)).alias("cid"), F.col("cid").alias("parent"), F.col("head_conv").alias("parent_conv"),
                               (F.col("last") + 1).alias("depth"), "ids", "words", "n", "conv_id", "ends"))
    rows = whole[0]
    for more in whole[1:]:
        rows = rows.unionByName(more)
    nodes = _swept(rows)
    if not heads:
        return nodes.select(*_SUMS, "ends_sha256")
    nodes = stash(nodes)
    below = nodes.where(F.col("top") & F.col("parent").isNotNull()).select("parent", "n_leaves", "saved_tokens")
    out, tops = [nodes.select(*_SUMS, "ends_sha256")], None
    for head in reversed(heads):
        parts = below if tops is None else below.unionByName(tops)
        total = parts.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("rest"))
        full = head.join(total.withColumnRenamed("parent", "cid"), "cid")
        own = lambda words: (F.col("n") - 1) * F.reduce(words, F.lit(0).cast("long"), lambda a, x: a + x)
        tops = full.where(F.col("parent").isNotNull()).select("parent", "n_leaves", (F.col("rest") + own(F.col("words"))).alias("saved_tokens"))
        chain = full.select("*", F.posexplode("words").alias("i", "word"))
        last = F.col("depth") + F.col("i") == F.col("last")
        out.append(chain.select(
            "conv_id", (F.col("depth") + F.col("i")).cast("long").alias("depth"), F.when(F.col("i") == 0, F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
            (F.col("rest") + own(F.slice("words", F.col("i") + 1, F.size("words")))).alias("saved_tokens"),
            F.when(last, F.col("ends")).otherwise(_NO_ENDS).alias("ends_sha256")))
    got = out[0]
    for more in out[1:]:
        got = got.unionByName(more)
    return got
