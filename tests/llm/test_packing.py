import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import packing as P
from ledgerline.llm import queries as Q
from ledgerline.llm.byte_bpe import SLICE

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a<|endoftext|>b", " lead", "trail ", "two  blanks", "line\n\nline", "a \nb", "tab\tx", "x　y z", "don't WE'LL 12½١", "\n", " ",
       "é à\x85b\x1cc", "a\n", "\na", "x\r\ny", "名前 は", "a\x00b c", "😀 ok", "<| x", "a b\nc d.\ne"]


def reference_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_equal_the_tokenizers_library(real_texts):
    rng = random.Random(1)
    letters = ["a", "B", " ", "\n", "é", "'", "9", ".", "\t", "日", "<|", " "]
    texts = ODD + [t for _, t in real_texts if t][:60] + ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(400)]
    tok = Tokenizer.from_file(PATH)
    for t in texts:
        assert np.frombuffer(P.encode(PATH, t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_a_text_is_encoded_in_few_calls(monkeypatch):
    text = " ".join(f"only{k}once" for k in range(20_000))
    want, calls = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, []
    P.encoder(PATH)
    for name in ("encode", "encode_ordinary", "encode_to_numpy", "_encode_single_piece"):
        inner = getattr(tiktoken.Encoding, name)
        monkeypatch.setattr(tiktoken.Encoding, name, lambda self, t, inner=inner, **more: (calls.append(len(t)), inner(self, t, **more))[1])
    assert np.frombuffer(P.encode(PATH, text), "<u4").tolist() == want
    assert 1 < len(calls) <= len(text) // SLICE + 1 and sum(calls) == len(text)


def test_slices_change_no_id():
    rng = random.Random(2)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "'s", "9", ".", "日", "<|", "<|endoftext|>", "\u3000", "\x85", "word "]
    tok = Tokenizer.from_file(PATH)
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        want = tok.encode(text, add_special_tokens=False).ids
        for size in (1, 4, SLICE):
            assert np.frombuffer(P.encode(PATH, text, size), "<u4").tolist() == want, repr(text)


def test_very_long_white_space():
    tok = Tokenizer.from_file(PATH)
    for text in ("a" + " " * 3000 + "<|endoftext|>" + "\n" * 3000 + "b", " " * 5000, "x " + " \t" * 2000):
        assert np.frombuffer(P.encode(PATH, text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    ids = np.frombuffer(P.encode(PATH, " " * 1_000_000), "<u4").tolist()   # overflows the library's pattern engine whole
    assert P.encoder(PATH)[0].decode(ids) == " " * 1_000_000


def check(rows, got, capacity=2048):
    """Every document whole and in order, every sequence gapless and within capacity; returns the number of sequences."""
    want = defaultdict(list)
    for i, t in rows:
        ids = reference_ids(t)
        first = len(ids) - capacity * ((len(ids) - 1) // capacity)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i].append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    have, bins = defaultdict(list), defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_query(spark, real_texts):
    got = Q.op5_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    n = check(real_texts, got)
    assert n <= -(-sum(r.length for r in got) // 2048) * 1.02 + 1


def test_edge_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "x"), (3, "same text"), (3, "same text"), (4, "word " * 30000), *((10 + k, t) for k, t in enumerate(ODD))]
    docs = docs_of(rows).withColumn("length", F.lit("clash")).withColumn("sequence_id", F.lit(3))
    pieces = P.token_pieces(docs, PATH)
    got = P.pack(pieces.withColumn("ids_crc32", F.crc32("ids")))
    check(rows, got.collect())
    assert P.pack(P.token_pieces(docs.limit(0), PATH)).count() == 0


def test_exact_multiple_of_capacity(docs_of):
    rows = [(1, "a b c d e f g"), (2, "a b c"), (3, "a b c d")]
    pieces = [(r.doc_id, r.piece, r.start, r.length) for r in P.token_pieces(docs_of(rows), PATH, capacity=4).collect()]
    assert sorted(pieces) == [(1, 0, 0, 4), (1, 1, 4, 4), (2, 0, 0, 4), (3, 0, 0, 1), (3, 1, 1, 4)]


def test_bounded_bins_close_the_fullest():
    b = P.BestFit(10, 2)
    assert [b.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]   # the third closes bin 1, the fuller of two
    assert b.place(3) == (0, 6) and b.place(2) == (2, 8) and b.open == 1
