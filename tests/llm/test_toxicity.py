import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import queries as Q
from ledgerline.llm import toxicity as T


def dense(counts, idf):
    v = np.zeros(len(idf))
    for t, n in counts.items():
        v[t] = (1 + math.log(n)) * idf[t]
    v[-1] = idf[-1]
    return v / np.linalg.norm(v)


def test_nearest_is_exact_with_ties(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 8)
    rng = random.Random(4)
    rand = lambda: {rng.randrange(30): rng.randrange(1, 4) for _ in range(rng.randrange(5))}
    examples = [(i, rand(), rng.randrange(2)) for i in range(400)]
    m = T.build_model([b"t%d" % k for k in range(30)], examples, {k: 3 * k for k in range(30)}, 500, k=7)
    x = np.array([dense(c, m.idf) for _, c, _ in examples])
    order = {tuple(round(float(w), 9) for w in dense(c, m.idf)) for _, c, _ in examples}
    assert len(m.entries) == len(order) and m.entries[:, 0].sum() == 400
    for _ in range(60):
        q = rand()
        cos = np.round(x @ dense(q, m.idf), 9)
        kth = np.sort(cos)[-7]
        at, sim = m.nearest(m.vector(q))
        assert np.isclose(sim.min(), kth, atol=1e-8)
        assert m.entries[at, 0].sum() == (cos >= kth).sum()
        w = 1 / (np.maximum(0, 1 - cos[cos >= kth]) + 0.05)
        want = (w * np.array([e[2] for e in examples])[cos >= kth]).sum() / w.sum()
        assert np.isclose(m.vote(m.vector(q))[0], want, atol=1e-6)


def test_isotonic_curve_is_monotone():
    x, y = T._isotonic(np.array([0, 0.1, 0.1, 0.3, 0.5, 0.9, 1.0]), np.array([0, 0, 1, 0, 1, 1, 1.0]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and 0 < y[0] < y[-1] < 1


ROWS = [(i, f"plain words number {i} here" + (" vilest grubling" if i % 4 == 0 else "") + " x" * (i % 5)) for i in range(1, 121)]
EDGE = [(500, None), (501, ""), (None, "vilest grubling thing"), (502, "vilest grubling thing"), (502, "vilest grubling thing"),
        (503, "word " * 200_000), (504, "z" * 2_000_000), (505, "VILEST *** Grubling!")]


def test_edge_rows(spark, docs_of, labels_of):
    docs = docs_of(ROWS + EDGE).withColumn("toxic", F.lit("clash")).withColumn("score", F.lit(9)).withColumn("id", F.lit(1))
    labels = labels_of([(i, int(i % 4 == 0)) for i in range(1, 121)] + [(None, 1), (9, None), (999, 1), (3, 0)])
    got = T.score_toxicity(docs, labels, out="t")
    assert got.columns == [*docs.columns, "t"]
    rows = got.collect()
    assert len(rows) == len(ROWS + EDGE) and all(0 <= r.t.score <= 1 for r in rows)
    bad = {str(r.doc_id) for r in rows if r.t.predicted}
    assert bad == {str(i) for i, _ in ROWS if i % 4 == 0} | {"None", "502", "505"}
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(ROWS + EDGE) - sum(r.t.predicted for r in rows)


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(4, 1), (8, 1)]])
def test_no_or_one_kind_of_label(docs_of, labels_of, labels):
    rows = T.score_toxicity(docs_of(ROWS + EDGE), labels_of(labels), out="t").collect()
    assert len(rows) == len(ROWS + EDGE) and all(0 <= r.t.score <= 1 for r in rows)
    assert T.score_toxicity(docs_of(ROWS).limit(0), labels_of(labels)).count() == 0


def test_query_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.op2_toxicity(spark, sf).collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    fresh = [(truth[i], r.predicted) for i, r in got.items() if r.held_out and i in truth]
    assert sum(a == b for a, b in fresh) / len(fresh) > 0.95
    assert not any(p and not t for t, p in fresh)


@pytest.mark.parametrize("share, size", [(5, 400), (40, 400), (60, 400), (90, 400), (40, 30)])
def test_every_share_of_toxic_examples(docs_of, labels_of, share, size):
    rng = random.Random(share)
    toxic = lambda i: i * 37 % 100 < share if size >= 100 else i % 5 < 2
    rows = [(i, " ".join([f"w{rng.randrange(50)}" for _ in range(12)] + ["grubling"] * toxic(i))) for i in range(2 * size)]
    got = T.score_toxicity(docs_of(rows), labels_of([(i, int(toxic(i))) for i in range(size)]), out="t").collect()
    assert {r.doc_id for r in got if r.t.predicted} == {i for i, _ in rows if toxic(i)}


def test_rare_markers_are_learnt(docs_of, labels_of):
    rows = [(i, f"plain text {i} " + (f"marker{'abcdefghijkl'[i // 2 % 12]}" if i % 2 else "") * (i % 4 != 2)) for i in range(2400)]
    rows = [(i, t + (" common" if i % 2 and i < 2200 else "") + (" rareword" if i % 2 and 2000 <= i < 2040 else "")) for i, t in rows]
    terms = T.select_terms(docs_of(rows).selectExpr("text", "cast(doc_id % 2 as int) AS toxic"))
    assert {b"rareword", b"common"} <= set(terms) and not {b"plain", b"text"} & set(terms)


def test_tail_of_the_exact_test():
    for total, toxic, n in ((30, 12, 9), (50, 45, 20), (7, 3, 7)):
        for a in range(max(0, n - total + toxic), min(n, toxic) + 1):
            want = sum(math.comb(toxic, x) * math.comb(total - toxic, n - x) for x in range(a, min(n, toxic) + 1)) / math.comb(total, n)
            assert math.isclose(math.exp(T._log_tail(a, n, toxic, total)), want, rel_tol=1e-9)


def test_labels_of_absent_documents_use_up_no_examples(docs_of, labels_of):
    labels = labels_of([(i, int(i % 4 == 0)) for i in range(1, 121)] + [(i, 0) for i in range(10_000, 14_000)])
    assert int(T.fit(docs_of(ROWS), labels, max_examples=120).entries[:, 0].sum()) == 120
