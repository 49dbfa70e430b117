import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import byte_bpe as B
from ledgerline.llm import queries as Q

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LETTERS = ["a", "B", "s", "'s", "'", " ", "  ", "\n", "\t", "é", "9", "12", ".", "...", "日", "　", "\x85", "\x1c", "\xa0", "٣", "<|endoftext|>", "\U0001f9ff"]


@pytest.fixture(scope="module")
def enc():
    return B.encoding(PATH, PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(LETTERS), max_size=40), st.integers(1, 12))
def test_slices_change_no_id(parts, size):
    enc, text = B.encoding(PATH, PATTERN), "".join(parts)
    whole = enc.encode_ordinary(text)
    assert "".join(p for p, _ in B.slices(text, size)) == text
    got = [i for part, single in B.slices(text, size) for i in (enc._encode_single_piece(part) if single else enc.encode_ordinary(part))]
    assert got == whole and B.decode(enc, got) == text.encode()


def test_long_white_space(enc):
    rng = random.Random(1)
    for n in (B.LONG_RUN - 1, B.LONG_RUN, B.LONG_RUN + 1, 3 * B.LONG_RUN):
        for tail in ("", "x", "9", ".", "\x1c", "'s"):
            for head in ("", "word", "it's "):
                run = "".join(rng.choice(" \n\t　") for _ in range(n))
                assert B.encode(enc, head + run + tail).tolist() == enc.encode_ordinary(head + run + tail)
    for text in (" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", (" " * 5000 + "x") * 50):     # the first two overflow the library
        assert B.decode(enc, B.encode(enc, text).tolist()) == text.encode()


def test_rows(docs_of, enc):
    long = "word 1a2b, it's " * 30_000
    rows = [(1, None), (2, ""), (None, "x"), (3, "same text"), (3, "same text"), (4, long), (5, "z" * 200_000), (6, "<|endoftext|>\x00\x1c")]
    docs = docs_of(rows).withColumn("IDs", F.lit("kept"))
    got = B.encode_texts(docs, PATH, PATTERN, out="t")
    assert got.columns == [*docs.columns, "t"]
    back = B.decode_ids(got, PATH, PATTERN, "t", out="b").collect()
    assert len(back) == len(rows)
    assert sorted((str(r.doc_id), r.t, bytes(r.b)) for r in back) == sorted((str(i), enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert B.encode_texts(docs.limit(0), PATH, PATTERN, out="t").count() == 0


def test_ids_out_of_the_vocabulary(spark):
    rows = spark.createDataFrame([(1, [72, 101]), (2, [50_256]), (3, [-1]), (4, [None]), (5, None), (6, []), (7, [1 << 40])], "k int, ids array<long>")
    got = {r.k: r.b for r in B.decode_ids(rows, PATH, PATTERN, out="b").collect()}
    assert {k: got[k] for k in (2, 3, 4, 7)} == {2: None, 3: None, 4: None, 7: None} and got[5] == got[6] == b"" and got[1]


def test_query(spark, real_texts, enc):
    want = []
    for i, t in real_texts:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, Q.op11_byte_bpe(spark, "/root/testdata/sf0.001").collect())) == sorted(want)
