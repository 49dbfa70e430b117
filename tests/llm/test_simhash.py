import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import queries as Q
from ledgerline.llm import simhash as S
from ledgerline.llm.components import connected_components


def simple(text, k=3):
    ws = (text or "").encode().lower().split()
    grams = [b" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1)] if len(ws) >= k else ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def groups(fps, bits=2):
    """Least index reachable, by comparing all pairs."""
    x = np.array(fps, np.uint64)
    label = np.arange(len(x))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= bits
    while True:
        new = np.where(near, label[None, :], len(x)).min(1)
        if (new == label).all():
            return label
        label = new


def test_fingerprint():
    for t in [None, "", " \t", "one", "Two words", "three Little words", "a b c " * 9, "É é x\x1cy z w q", " ".join(map(str, range(40000)))]:
        assert S.fingerprint(t) == simple(t)


def test_groups_against_brute_force(docs_of):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 160))] for _ in range(30)]
    rows = [(100, None), (101, ""), (102, "zz"), (103, "zz"), (103, "zz"), (None, "zz yy"), (None, None), (None, "only here"), (104, "ZZ")]
    for k in range(240):
        ws = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            ws[rng.randrange(len(ws))] = f"w{rng.randrange(400)}"
        rows.append((1000 + rng.randrange(10 ** 6), " ".join(ws)))
    rng.shuffle(rows)
    rows.sort(key=lambda r: 2 ** 63 if r[0] is None else r[0])
    label = groups([simple(t) for _, t in rows])
    want = sorted((str(i), format(simple(t), "016x"), str(rows[label[k]][0])) for k, (i, t) in enumerate(rows))
    got = S.near_duplicate_groups(docs_of(rows, 5)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = S.drop_near_duplicates(docs_of(rows, 5))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.count() == len(set(label.tolist()))


def test_shards_and_local_trees_find_every_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2 ** 64, 60, dtype=np.uint64)
    x = np.concatenate([centre, *(c ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for c in centre[:25]),
                        rng.integers(0, 2 ** 64, 3000, dtype=np.uint64)])
    x = np.unique(x)
    monkeypatch.setattr(S, "SHARD", 300)
    monkeypatch.setattr(S, "LEAF", 40)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long").repartition(4)
    assert S.Shards(x, 300 / len(x), 2).count > 4
    comp = {r.node & (1 << 64) - 1: r.component for r in connected_components(S.link_fingerprints(df)).collect()}
    label = groups(x)
    mine = {}
    for k, v in enumerate(x.tolist()):
        c = comp.get(v, ("alone", v))
        assert mine.setdefault(int(label[k]), c) == c
    assert len(set(mine.values())) == len(mine)


def test_shards_that_divide_again_find_every_link(spark, monkeypatch):
    """A first tree that is far too coarse: 16 sampled fingerprints for 4,600."""
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2 ** 64, 60, dtype=np.uint64)
    near = [c ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for c in centre[:25]]
    x = np.unique(np.concatenate([centre, *near, *(n ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for n in near[:5]),
                                  rng.integers(0, 2 ** 64, 3000, dtype=np.uint64)]))
    for name, value in (("SHARD", 100), ("SAMPLE", 16), ("OWN_SAMPLE", 64), ("MOST_ROWS", 200)):
        monkeypatch.setattr(S, name, value)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long").repartition(6)
    divided, sizes = S.divide, []

    def seen(*args):
        out = divided(*args)
        sizes.extend(r["count"] for r in out.groupBy("shard").count().collect())
        homes = out.where("home").groupBy("fp").count().where("count <> 1").count()
        assert homes == 0 and out.where("home").count() == len(x)
        return out
    monkeypatch.setattr(S, "divide", seen)
    comp = {r.node & (1 << 64) - 1: r.component for r in connected_components(S.link_fingerprints(df)).collect()}
    want = groups([int(v) for v in x])
    for k, v in enumerate(x):
        assert comp.get(int(v), int(np.int64(v.view(np.int64)))) == int(x[want == want[k]].view(np.int64).min())
    assert len(sizes) > 30 and max(sizes) < len(x) / 4      # many shards, none near the whole


def test_components_long_path(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 150), (7, 7), (300, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 150: 100, 200: 100, 300: 100}


def test_empty_and_clashing(docs_of):
    none = docs_of([(1, "a")]).limit(0)
    assert S.near_duplicate_groups(none).count() == 0 and S.drop_near_duplicates(none).count() == 0
    df = docs_of([(1, "a b"), (2, "a b")]).withColumn("_rid", F.lit(5)).withColumn("component", F.lit("x")).withColumn("fp", F.lit(1))
    got = S.drop_near_duplicates(df)
    assert got.columns == df.columns and [(r.doc_id, r._rid) for r in got.collect()] == [(1, 5)]


def test_query(spark, real_texts):
    rows = sorted(real_texts)
    label = groups([simple(t) for _, t in rows])
    want = sorted((i, format(simple(t), "016x"), rows[label[k]][0]) for k, (i, t) in enumerate(rows))
    assert sorted(map(tuple, Q.op7_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect())) == want
