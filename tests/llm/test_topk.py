import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import queries as Q
from ledgerline.llm import topk as T
from ledgerline.llm.topk import top_k


def brute(rows, is_query, k):
    good = {(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out, found = [], {}
    for i, q in good:
        if is_query(i):
            hits = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i and len(c) == len(q))[:k]
            found.setdefault(i, []).extend(hits)
    for i, hits in found.items():
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(hits)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 3, 450])
def test_edges_against_brute_force(spark, shards):
    rng = random.Random(shards)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [rng.choice([0.0, 0.5, -0.25]) for _ in range(6)]) for i in range(200)]     # many ties
    rows += [(20, rows[20][1])] * 30 + [(30, [0.1] * 6), (41, [0.0] * 6), (60, [0.0] * 6)]
    rows += [(None, [1.0] * 6), (70, None), (71, []), (80, [float("nan")] * 6), (81, [float("inf")] * 6), (82, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
             (90, [1.0, 2.0]), (91, [1.0, -2.0]), (92, [1e3] * 6), (110, [-1e3] * 6), (120, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5) \
        .withColumns({"id": F.lit(0), "v": F.lit("x"), "cell": F.lit(1), "score": F.lit(2)})
    got = top_k(df, F.col("vec_id") % 10 == 0, k=7, shards=shards)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0, 7)


def lists_against_brute_force(values, queries, k=10):
    ids = np.arange(len(values)) * 3
    lists = T.SortedLists(ids, values)
    for j, got, score in lists.top(queries, np.full(len(queries), 30), k):
        want = sorted((-int(values[i] @ queries[j]), int(ids[i])) for i in range(len(values)) if ids[i] != 30)[:k]
        assert [(-s, i) for i, s in zip(got.tolist(), score.tolist())] == want
    share = len(queries) * len(values)
    return lists.read / (share * values.shape[1]), lists.resolved / share


def test_skewed_vectors_are_mostly_left_out():
    rng = np.random.default_rng(5)
    weight = 0.7 ** np.arange(64)
    values, queries = (np.floor(1024 * rng.standard_normal((n, 64)) * weight).astype(np.int64) for n in (4000, 25))
    read, resolved = lists_against_brute_force(values, queries)
    assert read < 0.2 and resolved < 0.02


def test_dense_vectors_are_not_read_to_the_end():
    rng = np.random.default_rng(6)
    values, queries = (np.floor(1024 * rng.standard_normal((n, 64)) / 8).astype(np.int64) for n in (4000, 25))
    read, resolved = lists_against_brute_force(values, queries)
    assert read < 0.95 and resolved < 0.05


def test_lists_with_ties_zeros_and_equal_columns():
    rng = np.random.default_rng(7)
    for n, size, top in ((1, 3, 1), (60, 3, 2), (500, 5, 3), (500, 4, 1)):
        values, queries = rng.integers(-top, top + 1, (n, size)), rng.integers(-1, 2, (30, size))
        values[:, 0] = 2
        lists_against_brute_force(values, queries, 4)


def test_grid_follows_the_components(spark, monkeypatch):
    sizes = spark.range(10_000).selectExpr("IF(id % 7 = 0, NULL, 64) AS n", "id % 100 = 0 AS ask")
    assert T._grid(sizes, 8) == (1, 8)
    monkeypatch.setattr(T, "CELL_COMPONENTS", 1000)
    assert T._grid(sizes, 8) == (6, 549) and T._grid(sizes.limit(0), 8) == (1, 8)


def test_fewer_than_k_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [0.5, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(df, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 1024 * 512), (0, 2, 2, 1024 * 512)]
    assert top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert top_k(df, F.lit(False)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, Q.op3_exact_topk(spark, sf).collect())) == brute(rows, lambda i: i % 100 == 0, 10)
