"""Exact top-k inner products by no-random-access aggregation (NRA) over sorted lists.

Vectors become integers, floor(scale * x). Candidates are dealt into shards by a hash of their id; each shard sorts one
list a dimension. A query reads its lists from the end that its sign favours, a piece at a time, always on the list whose unread
rest can still move a score most (|query| times the spread of the rest), so that fronts fall where it pays. Scores add up from the
entries as they are read. A candidate's score is bounded below and above by that sum plus, for each list where it was not read, the
worst value of that list and the value the list has reached. A candidate whose upper bound falls under the k-th best lower bound is out;
candidates never read have the sum of the fronts as their upper bound. Reading stops when few are left in (or the lists end),
and the final scores of those left are resolved from their unread entries. Shards' results merge by a grouped top-k.

Queries meet candidates on a grid: ``rows x shards`` cells, queries copied along the shards and candidates along the rows, the shape with
the least copying for queries of a given share. Both sides of a cell are bounded: their numbers of components are counted first and
divided by a fixed size. No side is broadcast or collected.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part; vectors meet only vectors of their
own length. A null id takes no part. Exact repeats of a row count once; of rows with one id and different vectors each is a
candidate, all rows of the query's own id are left out, and a repeated query id ranks the hits of its vectors together. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._frames import bounded_batches, shuffle_partitions

SCALE, K = 1024, 10
PIECES, LEAST = 2, 1024        # a list is read in so many pieces, of at least so many entries
LOOK = 0.6                     # the bounds are looked at whenever the spread of all that is unread has fallen to this share
RESOLVE = 4                    # reading stops when every query has at most this times k candidates left
QUERY_BLOCK = 256
CELL_COMPONENTS = 1 << 22      # vector components of a side of a cell; a candidate's take 16 bytes each
_HITS = "query_id long, vec_id long, score long"


class SortedLists:
    """The lists of one shard: every dimension's candidates by falling value. Exact repeats of a row count once.

    ``read`` and ``resolved`` count the list entries read and the (query, candidate) scores that were resolved at the end."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        rows = np.unique(np.column_stack((ids, values)), axis=0)     # by id, which settles ties
        self.ids, values = np.ascontiguousarray(rows[:, 0]), rows[:, 1:].T
        self.who = np.argsort(-values, axis=1, kind="stable").astype(np.int32)
        self.value = np.take_along_axis(values, self.who, axis=1)
        self.place = np.empty_like(self.who)                          # by dimension and candidate: how deep in the list
        np.put_along_axis(self.place, self.who, np.arange(len(rows), dtype=np.int32)[None, :], axis=1)
        self.read = self.resolved = 0

    def _read(self, query: np.ndarray, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Read on until few are left of ``alive``, which loses the others: sums of the entries read, and 1 for each entry unread
        (dimension by candidate)."""
        n = len(self.ids)
        score, unread = np.zeros(n, np.int64), np.ones(self.who.shape)
        unread[query == 0] = 0
        worst = np.where(query > 0, self.value[:, -1], self.value[:, 0]) * query.astype(float)
        front = np.where(query > 0, self.value[:, 0], self.value[:, -1]) * query.astype(float)
        slack = 1e-9 * (1 + np.maximum(np.abs(front), np.abs(worst)).sum())   # of the float bounds
        pos, piece, seen = [0] * len(query), max(LEAST, -(-n // PIECES)), (front - worst).sum()
        gap, left = front - worst, alive.sum()
        while left > RESOLVE * k:
            d = int(gap.argmax())
            if gap[d] <= 0:                                           # what is unread is the same for every candidate
                break
            a, b = pos[d], min(n, pos[d] + piece)
            part = slice(a, b) if query[d] > 0 else slice(n - b, n - a)   # lists of negative weight are read from the bottom
            who = self.who[d, part]
            score[who] += query[d] * self.value[d, part]
            unread[d, who] = 0
            pos[d], self.read = b, self.read + b - a
            front[d] = worst[d] if b == n else float(query[d]) * self.value[d, b if query[d] > 0 else n - 1 - b]
            gap[d] = front[d] - worst[d]
            if gap.sum() <= LOOK * seen:
                seen = gap.sum()
                at = np.flatnonzero(alive)
                bounds = np.vstack((worst, front))
                lower, upper = (bounds @ unread[:, at] if left * 4 < n else (bounds @ unread)[:, at]) + score[at]
                alive[at] = upper >= np.partition(lower, -k)[-k] - slack
                left = alive.sum()
        return score, unread

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query number, ids, scores) of each query's ``k`` best, ties to the smaller id, without its ``own`` id."""
        for j, query in enumerate(queries):
            alive = self.ids != own[j]
            score, unread = self._read(query, alive, k)
            at = np.flatnonzero(alive)
            rest = unread[:, at] > 0
            self.resolved += int(rest.any(0).sum())
            for d in np.flatnonzero(rest.any(1)):
                mine = at[rest[d]]
                score[mine] += query[d] * self.value[d, self.place[d, mine]]
            best = at[np.argsort(-score[at], kind="stable")[:k]]      # candidates are in the order of their ids
            yield j, self.ids[best], score[best]


def _matrix(blob: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(blob.to_pylist()), "<i8").reshape(-1, size)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        whole = pa.Table.from_batches(tables)
        for size in sorted(set(whole.column("size").to_pylist())):
            part = whole.filter(pc.equal(whole.column("size"), size)).combine_chunks()
            asks = part.filter(part.column("ask"))
            rest = part.filter(pc.invert(part.column("ask")))
            if not asks.num_rows or not rest.num_rows:
                continue
            lists = SortedLists(rest.column("id").to_numpy(), _matrix(rest.column("v"), size))
            own, wanted = asks.column("id").to_numpy(), _matrix(asks.column("v"), size)
            for at in range(0, len(own), QUERY_BLOCK):
                found = list(lists.top(wanted[at:at + QUERY_BLOCK], own[at:at + QUERY_BLOCK], k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own[at:at + QUERY_BLOCK], [len(ids) for _, ids, _ in found])),
                     pa.array(np.concatenate([ids for _, ids, _ in found])), pa.array(np.concatenate([x for _, _, x in found]))],
                    ["query_id", "vec_id", "score"])

    return run


def _integers(scale: int):
    def of(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors:
            x = np.array([math.nan if y is None else y for y in v.as_py()] if v.is_valid else [], np.float64)
            out.append(np.floor(scale * x).astype("<i8").tobytes() if len(x) and np.isfinite(x).all() else None)
        return pa.array(out, pa.binary())

    return F.arrow_udf(of, "binary")


def _grid(sizes: DataFrame, cells: int) -> tuple[int, int]:
    """(rows, shards) of at least about ``cells`` cells, with at most ``CELL_COMPONENTS`` components of queries or of candidates in a cell
    (up to the evenness of a hash)."""
    every, asks = sizes.agg(F.sum("n"), F.sum(F.when(F.col("ask"), F.col("n")))).first()
    rows = max(1, round(math.sqrt(cells / 100)), -(-(asks or 0) // CELL_COMPONENTS))  # queries are about a hundredth of the candidates
    return rows, max(1, cells // rows, -(-(every or 0) // CELL_COMPONENTS))


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE,
          shards: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best inner products of each query among all other vectors."""
    bounded_batches(vectors.sparkSession)
    rows, across = _grid(vectors.select(F.array_size(vector_col).alias("n"), is_query.alias("ask")),
                         shards or shuffle_partitions(vectors.sparkSession))
    base = vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("ask"),
                          _integers(scale)(F.col(vector_col).cast("array<double>")).alias("v")) \
        .where("id IS NOT NULL AND v IS NOT NULL").select("id", "ask", "v", (F.octet_length("v") / 8).cast("int").alias("size"))
    line = F.pmod(F.xxhash64("id", "v"), F.lit(across)).cast("int")
    row = F.pmod(F.xxhash64("v", "id"), F.lit(rows)).cast("int")
    candidates = base.select("id", F.lit(False).alias("ask"), "v", "size",
                             F.explode(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: r * across + line)).alias("cell"))
    queries = base.where("ask").select("id", "ask", "v", "size").distinct() \
        .select("id", "ask", "v", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda c: row * across + c)).alias("cell"))
    hits = candidates.unionByName(queries).repartitionById(rows * across, F.col("cell")).mapInArrow(_search(k), _HITS)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
