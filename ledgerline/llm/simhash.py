"""SimHash near-duplicates: 64-bit fingerprints that differ in few bits, found with vantage-point trees.

Fingerprint: A-Z lower-cased, words split at ASCII white space, shingles of ``shingle`` words (repeats
included; a shorter text is one shingle), XXH64 with seed 42 of each; a bit is 1 if over half of the hashes
set it. A text without words (or null) has fingerprint zero and links like any other.

Links: equal fingerprints are grouped first, so copies cost nothing. A vantage-point tree over a bounded
sample splits the distinct fingerprints by Hamming distance to a vantage point into shards; a fingerprint within
``max_bits`` of a border also visits the other side (triangle inequality), so each pair within
``max_bits`` meets in the home shard of either. Where the input is so large that the sample cannot tell shards of the wanted size apart,
shards of more than ``MOST_ROWS`` rows go on dividing in Spark, level by level: each draws a vantage point from a bounded sample of its own, and its
rows are dealt by distance. A shard searches its own vantage-point tree with the same
bounds and emits a star a local component instead of all pairs. Stars join to components across shards.

A shard cannot be split further only where its fingerprints lie within a few bits of each other; that
many different 64-bit values is a constant of the geometry (a ball of radius 4 has 679,121), not of the input.

Defined cases: null ids count as the largest id and give component_id null if nothing else is in the group.
Repeated rows each get a row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import LAST_ID, free_name, order_id, stash, text_key, text_of
from .components import connected_components

SHINGLE, MAX_BITS = 3, 2
SAMPLE = 8192          # fingerprints that the driver sees to place the shards' borders
SHARD = 16384          # distinct fingerprints a shard, about
LEAF = 256
MOST_ROWS = 1 << 20    # rows of a shard, visitors included, above which it divides again (9 bytes each)
OWN_SAMPLE = 1024      # fingerprints, about, that a shard draws to divide again
_LEAST = 8             # sampled fingerprints that a shard of the first tree stands on at least
_CANDIDATES = 24       # vantage points tried at a node


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text, as an unsigned integer."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    grams = zip(*(ws[k:] for k in range(shingle))) if len(ws) >= shingle else [ws]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(g), 42) for g in grams), np.uint64, max(1, len(ws) - shingle + 1))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k:k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(docs: DataFrame, text_col: str, shingle: int = SHINGLE):
    def of(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), shingle) for t in text], np.uint64).view(np.int64), pa.int64())

    return F.arrow_udf(of, "long")(text_of(docs, text_col))


def _far(points: np.ndarray, one: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ one).astype(np.int16)


def _split(points: np.ndarray, bits: int) -> tuple[np.uint64, int] | None:
    """The vantage point and radius whose border strip holds the fewest points; None if no split helps."""
    best, cost = None, 0.95 * len(points)
    for one in points[:: max(1, len(points) // _CANDIDATES)][:_CANDIDATES]:
        d = _far(points, one)
        upto = np.cumsum(np.bincount(d, minlength=65 + 2 * bits))
        near = np.arange(65)
        inner = upto[np.minimum(near + bits, 64)]                                         # inside, or close outside
        outer = len(points) - np.where(near >= bits, upto[np.maximum(near - bits, 0)], 0)  # outside, or close inside
        worst = np.maximum(inner, outer) + 0.1 * (inner + outer - len(points))
        k = int(worst.argmin())
        if worst[k] < cost:
            best, cost = (one, k), float(worst[k])
    return best


class Shards:
    """The upper vantage-point tree: nodes (vantage point, radius, inner, outer); a leaf is a shard number."""

    def __init__(self, sample: np.ndarray, share: float, bits: int):
        """``share``: the part of all fingerprints that one shard may hold."""
        self.bits, self.nodes, self.count = bits, [], 0
        self.root = self._grow(sample, max(float(_LEAST), share * len(sample)))

    def _grow(self, points: np.ndarray, most: float) -> int:
        cut = _split(points, self.bits) if len(points) > most else None
        if cut is None:
            self.count += 1
            return -self.count
        k = len(self.nodes)
        self.nodes.append(None)
        d = _far(points, cut[0])
        self.nodes[k] = (*cut, self._grow(points[d <= cut[1]], most), self._grow(points[d > cut[1]], most))
        return k

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, indexes of the points that go there, whether it is their home) for every shard reached."""
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield -node - 1, at, home
                continue
            one, radius, inner, outer = self.nodes[node]
            d = _far(points[at], one)
            go_in, go_out = d - self.bits <= radius, d + self.bits > radius
            todo.append((inner, at[go_in], (home & (d <= radius))[go_in]))
            todo.append((outer, at[go_out], (home & (d > radius))[go_out]))


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of the component of each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _stars(queries: np.ndarray, data: np.ndarray, points: np.ndarray, bits: int) -> tuple[list, list]:
    """Links of a leaf as stars: each linked query or datum with the least datum linked to it, however indirectly."""
    ends: tuple[list, list] = ([], [])
    block = max(1, (4 << 20) // max(1, len(data)))
    for k in range(0, len(queries), block):
        q = queries[k:k + block]
        near = np.bitwise_count(points[q][:, None] ^ points[data][None, :]) <= bits
        near &= q[:, None] != data[None, :]
        rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(rows):
            continue
        near = near[np.ix_(rows, cols)]
        label = np.arange(len(cols))
        while True:  # least label over two steps, datum to query to datum, until nothing changes
            of_q = np.where(near, label[None, :], len(cols)).min(1)
            new = np.minimum(label, np.where(near, of_q[:, None], len(cols)).min(0))
            if (new == label).all():
                break
            label = new
        ends[0].extend((q[rows], data[cols]))
        ends[1].extend((data[cols][of_q], data[cols][label]))
    return ends


def link_shard(points: np.ndarray, home: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (fingerprint, least linked fingerprint) among the home points and their visitors, by a local
    vantage-point tree: data are split at a node, queries go wherever the triangle inequality lets a link be."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    todo = [(np.flatnonzero(home), np.arange(len(points)))]
    while todo:
        data, queries = todo.pop()
        cut = _split(points[data], bits) if len(data) > LEAF else None
        if cut is None:
            if len(data):
                x, y = _stars(queries, data, points, bits)
                a += x
                b += y
            continue
        d, dq = _far(points[data], cut[0]), _far(points[queries], cut[0])
        todo.append((data[d <= cut[1]], queries[dq - bits <= cut[1]]))
        todo.append((data[d > cut[1]], queries[dq + bits > cut[1]]))
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    label = _components(len(points), np.concatenate(a), np.concatenate(b))
    linked = np.flatnonzero(label != np.arange(len(points)))
    return points[linked], points[label[linked]]


def _cut(key: tuple, sample: pa.Table, bits: int) -> pa.Table:
    """The vantage point and radius by which a shard divides, from its sample; no row if no border helps."""
    points = np.sort(sample.column("fp").to_numpy().view(np.uint64))
    cut = _split(points, bits)
    rows = [] if cut is None else [(key[0].as_py(), int(cut[0].view(np.int64)), cut[1])]
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.string()), "point": pa.array([r[1] for r in rows], pa.int64()),
                     "radius": pa.array([r[2] for r in rows], pa.int32())})


def divide(routed: DataFrame, bits: int, most: int) -> DataFrame:
    """``routed`` (shard, fp, home) with shards of more than ``most`` rows divided, until none is left that a border divides."""
    done = []
    while True:
        sizes = stash(routed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most))
        if sizes.isEmpty():
            break
        one_in = F.greatest(F.lit(1), F.floor(F.col("n") / OWN_SAMPLE)).cast("long")
        sample = routed.join(sizes, "shard").where(F.pmod(F.xxhash64("fp"), one_in) == 0).select("shard", "fp")
        cuts = stash(sample.groupBy("shard").applyInArrow(lambda key, rows: _cut(key, rows, bits), "shard string, point long, radius int"))
        done.append(routed.join(cuts.select("shard"), "shard", "left_anti"))
        far = F.bit_count(F.col("fp").bitwiseXOR(F.col("point")))
        sides = F.array(F.when(far - bits <= F.col("radius"), F.struct(F.lit("i").alias("side"), (F.col("home") & (far <= F.col("radius"))).alias("home"))),
                        F.when(far + bits > F.col("radius"), F.struct(F.lit("o").alias("side"), (F.col("home") & (far > F.col("radius"))).alias("home"))))
        dealt = routed.join(cuts, "shard").select("shard", "fp", F.explode(F.array_compact(sides)).alias("s"))
        routed = stash(dealt.select(F.concat("shard", "s.side").alias("shard"), "fp", F.col("s.home").alias("home")))
    for more in done:
        routed = routed.unionByName(more)
    return routed


def link_fingerprints(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints (column ``fp``, long) -> edges (a, b) that connect all within ``bits`` of each other."""
    spark = distinct.sparkSession
    total = distinct.count()
    some = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, total // (2 * SAMPLE)))) == 0)     # about twice the sample reaches the driver
    seen = [r.fp for r in some.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    shards = Shards(np.array(seen, np.int64).view(np.uint64), min(1.0, SHARD / max(1, total)), bits)
    tree = spark.sparkContext.broadcast(shards)  # at most SAMPLE / _LEAST nodes

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, at, home in tree.value.route(points):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(points[at].view(np.int64)),
                                                  pa.array(home)], ["shard", "fp", "home"])

    def star(points: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        points = points.view(np.uint64)
        order = np.argsort(points)  # the least index is then the least fingerprint, whatever the order of arrival
        x, y = link_shard(points[order], home.astype(bool)[order], bits)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("fp").to_numpy(zero_copy_only=False), b.column("home").to_numpy(zero_copy_only=False)) for b in batches]
        if parts:
            yield star(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def link_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards one after the other, in the order of their name."""
        now, fps, homes = None, [], []
        for b in batches:
            names = b.column("shard").to_pylist()
            edges = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            fp, home = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "home"))
            for lo, hi in zip(edges, edges[1:]):
                if lo < hi:
                    if now is not None and names[lo] != now:
                        yield star(np.concatenate(fps), np.concatenate(homes))
                        fps, homes = [], []
                    now = names[lo]
                    fps.append(fp[lo:hi])
                    homes.append(home[lo:hi])
        if fps:
            yield star(np.concatenate(fps), np.concatenate(homes))

    routed = distinct.select("fp").mapInArrow(route, "shard int, fp long, home boolean")
    if SHARD * len(seen) >= _LEAST * total:
        return routed.repartitionById(shards.count, F.col("shard")).mapInArrow(link, "a long, b long")
    parts = divide(stash(routed.withColumn("shard", F.col("shard").cast("string"))), bits, MOST_ROWS)
    return parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(link_each, "a long, b long")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                          max_bits: int = MAX_BITS) -> DataFrame:
    """One row a row of ``docs``: ``id_col``, fingerprint (16 lowercase hex digits), component_id (least id reachable),
    and first (true for the one text that stands for its group: the least id, then the least text key)."""
    rows = stash(docs.select(order_id(id_col).alias("id"), text_key(text_col).alias("key"),
                             fingerprint_column(docs, text_col, shingle).alias("fp")))
    least = stash(rows.groupBy("fp").agg(F.min(F.struct("id", "key")).alias("rep")))
    comps = stash(connected_components(link_fingerprints(least, max_bits)))
    known = least.join(comps, least.fp == comps.node, "left") \
        .select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    known = stash(known)
    heads = stash(known.groupBy("component").agg(F.min("rep").alias("head")))
    groups = stash(known.join(heads, "component").select("fp", "head"))
    null_id = F.lit(None).cast("long")
    return rows.join(groups, "fp").select(
        F.when(F.col("id") == LAST_ID, null_id).otherwise(F.col("id")).alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("head.id") == LAST_ID, null_id).otherwise(F.col("head.id")).alias("component_id"),
        (F.struct("id", "key") == F.col("head")).alias("first"), F.col("key").alias("text_key"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group, columns unchanged: the least id stays; of repeated rows, one."""
    rid, rkey = free_name(docs, "_rid"), free_name(docs, "_rkey")
    stay = near_duplicate_groups(docs, id_col, text_col, shingle, max_bits).where("first") \
        .select(order_id(id_col).alias(rid), F.col("text_key").alias(rkey)).distinct()
    named = docs.withColumns({rid: order_id(id_col), rkey: text_key(text_col)})
    return named.join(stay, [rid, rkey]).dropDuplicates([rid, rkey]).select(*[F.col(f"`{c}`") for c in docs.columns])
