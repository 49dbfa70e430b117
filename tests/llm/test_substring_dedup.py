import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import queries as Q
from ledgerline.llm import substring_dedup as S
from ledgerline.llm._frames import LAST_ID, partitions_for, shuffle_partitions
from ledgerline.llm.substring_dedup import remove_repeated_windows


def brute(rows, n=20):
    """{(id, text): (n_words, n_removed, kept text)} by exact word sequences."""
    split = {(i, t): (t or "").encode().split() for i, t in rows}
    first = {}
    for (i, t), ws in split.items():
        for p in range(len(ws) - n + 1):
            key, at = tuple(ws[p:p + n]), (2 ** 63 - 1 if i is None else i, p)
            first[key] = min(first.get(key, at), at)
    out = {}
    for (i, t), ws in split.items():
        gone = [False] * len(ws)
        for p in range(len(ws) - n + 1):
            if first[tuple(ws[p:p + n])] < (2 ** 63 - 1 if i is None else i, p):
                gone[p:p + n] = [True] * n
        out[i, t] = (len(ws), sum(gone), b" ".join(w for w, g in zip(ws, gone) if not g).decode())
    return out


def check(df, rows, n=20):
    want = brute(rows, n)
    got = [(r.doc_id, r.text, (r.d.n_words, r.d.n_removed, r.d.kept_text)) for r in remove_repeated_windows(df, n=n, out="d").collect()]
    assert len(got) == len(rows)
    for i, t, have in got:
        assert have == want[i, t]


def test_edge_cases(docs_of):
    a = " ".join(f"w{k}" for k in range(60))
    rows = [(5, a), (2, "x y\tz\n" + a + "  tail é\x00 \x1c end"), (9, a), (9, a), (7, None), (8, ""), (None, a + " last"),
            (None, None), (3, "short text"), (4, "a " * 70), (11, " ".join(f"w{k}" for k in range(19))), (12, a[:200] + " p " + a),
            (9, "other text " + a), (6, "\x0b\x0c\r ")]
    check(docs_of(rows), rows)


def test_random_small_windows(docs_of):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 25)))) for i in range(80)]
    check(docs_of(rows, 5), rows, n=4)


def test_very_long_text(docs_of):
    rng = random.Random(2)
    words = [f"v{rng.randrange(10 ** 6)}" for _ in range(700_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[300_000:300_100])), (3, "z" * 5_000_000)]
    check(docs_of(rows, 2), rows)


def test_rows_without_an_id_are_spread(docs_of, monkeypatch):
    keys = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63, 10_000)
    sizes = np.bincount(S._home(np.full(10_000, LAST_ID), keys, 16), minlength=16)
    assert sizes.min() > 400 and sizes.max() < 900
    rng = random.Random(4)
    rows = [(None, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 25)))) for _ in range(60)] + [(1, "a b c a b"), (-3, "c a b c a b b")]
    monkeypatch.setattr(S, "OWNER_BYTES", 50)  # many small owner partitions
    check(docs_of(rows, 4), rows, n=4)


def test_partitions_follow_the_bytes(spark, docs_of):
    df = docs_of([(1, "é" * 500), (2, None), (3, "x" * 1000)])
    assert partitions_for(df, "text", 10) == 200 and partitions_for(df, "text", 10 ** 6) == shuffle_partitions(spark)
    assert partitions_for(df.limit(0), "text", 10) == shuffle_partitions(spark)


def test_empty_table_and_clashing_columns(spark, docs_of):
    assert remove_repeated_windows(docs_of([(1, "a")]).limit(0)).count() == 0
    df = docs_of([(1, "a b"), (2, "c")]).withColumn("_rid", F.lit(1)).withColumn("_marks", F.lit("m")).withColumn("n_words", F.lit(-1)).withColumn("block", F.lit(0))
    got = remove_repeated_windows(df, out="d")
    assert got.columns == [*df.columns, "d"]
    assert {(r.doc_id, r.n_words, r.d.n_words) for r in got.collect()} == {(1, -1, 2), (2, -1, 1)}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf, real_texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q.op1_substring_dedup(spark, f"/root/testdata/{sf}").collect()}
    want = {i: (a, b, hashlib.sha256(k.encode()).hexdigest()) for (i, _), (a, b, k) in brute(real_texts).items()}
    assert got == want
    assert sum(v[1] for v in got.values()) > 0
