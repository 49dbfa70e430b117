import numpy as np

import corpus_pipeline as C
from ledgerline.llm import toxicity as T

from . import test_decontaminate as decon
from . import test_line_dedup as lines
from . import test_packing as packing
from . import test_simhash as simhash

SF = "/root/testdata/sf0.001"


def kept_words(text, hits):
    """``text`` without the hit words: up to the first word of a range, and on after its last."""
    import re
    spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(decon.LOWER))]
    out, at = [], 0
    for k, (a, b) in enumerate(spans):
        if k in hits:
            if k - 1 not in hits:
                out.append(text[at:a])
            at = b
    return "".join([*out, text[at:]])


def brute(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = T.fit(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if model.score(model.vocabulary.counts(t))[0] < 0.5]
    cut = lines.brute(rows)
    rows = sorted((i, cut[i, t][0]) for i, t in rows)
    label = simhash.groups([simhash.simple(t) for _, t in rows])
    rows = [rows[k] for k in np.unique(label)]
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = set()
    for _, t in bench:
        ws = decon.split(t)
        size = min(10, len(ws))
        grams |= {tuple(ws[p:p + size]) for p in range(len(ws) - size + 1 if ws else 0)}
    out = []
    for i, t in rows:
        ws, hit = decon.split(t), set()
        for size in {len(g) for g in grams}:
            for p in range(len(ws) - size + 1):
                if tuple(ws[p:p + size]) in grams:
                    hit.update(range(p, p + size))
        if len(hit) <= 0.5 * len(ws):
            out.append((i, kept_words(t, hit) if hit else t))
    return out


def test_run_against_brute_force(spark):
    want = brute(spark)
    got = C.run(spark, SF).collect()
    n = packing.check(want, got)
    assert 0 < len(want) < 200 and n <= -(-sum(r.length for r in got) // 2048) * 1.05 + 1


def test_stages_keep_columns_and_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "some words here"), (3, "x " * 50_000), (4, "a b c d e f"), (4, "a b c d e f"), (5, "unrelated text stays")]
    docs = docs_of(rows)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names, name
        kept = {r.doc_id: r.text for r in out.collect()}
        assert kept[5] == "unrelated text stays" and kept[4] == "a b c d e f" and kept[None] == "some words here", name
        assert stage(spark, docs.limit(0), SF).count() == 0
    packing.check(rows, C.STAGES[-1][1](spark, docs, SF).collect())


def test_n_chars_follows_the_text(spark, docs_of):
    docs = docs_of([(1, lines.SHORT), (2, "x\n" + lines.SHORT)])
    assert {(r.doc_id, r.n_chars) for r in C.line_dedup(spark, docs, SF).collect()} == {(1, len(lines.SHORT)), (2, 1)}
