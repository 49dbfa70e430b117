import hashlib
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerline.llm import queries as Q
from ledgerline.llm.decontaminate import mark_contamination, remove_contamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCH = StructType([StructField("item_id", StringType()), StructField("text", StringType())])


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, bench, n=10):
    grams = {}
    for item, t in bench:
        ws = split(t)
        size = min(n, len(ws))
        for p in range(len(ws) - size + 1 if ws else 0):
            grams.setdefault(tuple(ws[p:p + size]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for i, t in docs:
        ws, hit, items = split(t), set(), set()
        for size in sizes:
            for p in range(len(ws) - size + 1):
                found = grams.get(tuple(ws[p:p + size]))
                if found:
                    hit.update(range(p, p + size))
                    items |= found
        out.append((i, len(ws), len(hit), tuple(sorted(x for x in items if x is not None))))
    return sorted(out, key=str)


P = "Alpha beta, GAMMA delta épsilon zeta eta THETA iota kappa lambda mu"
BENCH_ROWS = [("b", P), ("a", "tiny item"), ("z", "x"), (None, "only null here one two three four five six seven eight"),
              ("n", None), ("e", " ... "), ("b", P), ("É", "É é")]
DOC_ROWS = [(1, "so " + P.lower().replace(" ", "--") + " end"), (2, None), (3, ""), (4, "A tiny-ITEM and X x"), (5, "clean text stays"),
            (6, "alpha beta gamma delta épsilon zeta eta theta iota"), (None, P), (7, P), (7, P), (8, "é É É é É"),
            (9, "only null here one two three four five six seven eight"), (10, (P + " filler ") * 3000), (11, "q" * 3_000_000), (12, "ÀB À\x00b")]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_edges_broadcast_and_join(spark, docs_of, limit):
    bench = spark.createDataFrame(BENCH_ROWS, BENCH)
    docs = docs_of(DOC_ROWS).withColumn("hash", F.lit("h")).withColumn("n_words", F.lit(-1))
    got = mark_contamination(docs, bench, out="c", broadcast_bytes=limit)
    assert got.columns == [*docs.columns, "c"]
    have = sorted(((r.doc_id, r.c.n_words, r.c.n_hit, tuple(r.c["items"])) for r in got.collect()), key=str)
    assert have == brute(DOC_ROWS, BENCH_ROWS)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], BENCH)
    assert [r.c.n_hit for r in mark_contamination(docs_of([(1, "a b")]), none, out="c").collect()] == [0]
    assert mark_contamination(docs_of([(1, "a")]).limit(0), spark.createDataFrame(BENCH_ROWS, BENCH)).count() == 0


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_removal(spark, docs_of, limit):
    rows = [(1, "keep this text as it is and a long tail that is clean, so it stays; then " + P + " and more words follow here."),
            (2, P), (3, "Clean  text, unchanged!\n"), (4, None)]
    got = {r.doc_id: r.text for r in remove_contamination(docs_of(rows), spark.createDataFrame([("b", P)], BENCH), broadcast_bytes=limit).collect()}
    assert set(got) == {1, 3, 4}
    assert got[3] == rows[2][1] and got[4] is None
    assert got[1] == "keep this text as it is and a long tail that is clean, so it stays; then  and more words follow here."


def test_query(spark, real_texts):
    sf = "/root/testdata/sf0.001"
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [(i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for i, n, h, x in brute(real_texts, bench)]
    assert sorted(map(tuple, Q.op10_benchmark_decontamination(spark, sf).collect())) == sorted(want)
    assert any(w[2] for w in want)
