import random

import public_tokenizers
from pyspark.sql import functions as F

from ledgerline.llm import queries as Q
from ledgerline.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


def greedy(word, starts, inner):
    at, n = 0, 0
    while at < len(word):
        pieces = starts if not at else inner
        size = next((k for k in range(min(len(word) - at, 40), 0, -1) if word[at:at + k] in pieces), 0)
        if not size:
            return 0
        at, n = at + size, n + 1
    return n


def counts(text, pieces, known):
    """(words, tokens, unknown) of a text by the rule over the whole vocabulary; byte pieces leave no word unknown."""
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    return len(words), sum(known[w] if w in known else known.setdefault(w, whole(w, pieces)) for w in words), 0


def vocabulary_pieces():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


def test_automaton_equals_greedy_longest_match():
    rng = random.Random(2)
    for _ in range(300):
        some = lambda: {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 9))}
        starts, inner = some(), some() | ({"a", "b"} if rng.random() < 0.5 else set())
        m = T.LongestMatch(starts, inner)
        for _ in range(40):
            w = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randrange(1, 15)))
            assert m.count(w) == greedy(w, starts, inner), (starts, inner, w)


def test_rows(docs_of):
    pieces, known = vocabulary_pieces(), {}
    rows = [(1, None), (2, ""), (None, "hello world"), (3, "Same  row"), (3, "Same  row"), (4, "a" * 300_000), (5, "\U0001f9ff x\x1cy\tz"), (6, "the " * 100_000)]
    df = docs_of(rows).withColumn("n_words", F.lit(1))
    got = T.count_tokens(df, PATH, out="t")
    assert got.columns == [*df.columns, "t"]
    assert sorted((str(r.doc_id), *r.t) for r in got.collect()) == sorted((str(i), *counts(t, pieces, known)) for i, t in rows)
    assert T.count_tokens(df.limit(0), PATH).count() == 0


def test_query(spark, real_texts):
    pieces, known = vocabulary_pieces(), {}
    assert sorted(map(tuple, Q.op8_token_counts(spark, "/root/testdata/sf0.001").collect())) == \
        sorted((i, *counts(t, pieces, known)) for i, t in real_texts)


def whole(word, pieces, byte_pieces=True):
    """Tokens of a word by greedy longest match with the mark as a letter; 0 if it cannot be cut."""
    text, at, n = "▁" + word, 0, 0
    while at < len(text):
        size = next((k for k in range(min(len(text) - at, 40), 0, -1) if text[at:at + k] in pieces), 0)
        if not size and not byte_pieces:
            return 0
        n += 1 if size else len(text[at].encode())
        at += size or 1
    return n


def test_bare_mark_and_byte_pieces():
    rng = random.Random(3)
    for _ in range(300):
        some = lambda: {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 9))}
        pieces = {"▁" + x for x in some()} | some() | ({"▁"} if rng.random() < 0.5 else set())
        for byte_pieces in (False, True):
            m = T.LongestMatch({p[1:] for p in pieces if p[0] == "▁"}, pieces, byte_pieces)
            for _ in range(40):
                w = "".join(rng.choice("abcéd▁日" if rng.random() < 0.2 else "abcé") for _ in range(rng.randrange(1, 15)))
                assert m.count(w) == whole(w, pieces, byte_pieces), (pieces, byte_pieces, w)


def test_whole_vocabulary(docs_of):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces, known = vocabulary_pieces(), {}
    rows = [(-1, "1234567890"), (-2, "Ελλάδα"), (-3, "日本語の文章"), (-4, "\U0001f9ff x\x1cy a▁b")]
    got = {r.doc_id: tuple(r.t) for r in T.count_tokens(docs_of(rows), PATH, out="t").collect()}
    assert got == {i: counts(t, pieces, known) for i, t in rows}
    assert [got[k][1] for k in (-1, -2)] == [len(model.encode(t)) for _, t in rows[:2]] == [11, 7]
