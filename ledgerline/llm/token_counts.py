"""Word-piece token counts without building the pieces: a linear longest-match automaton.

Method: the vocabulary is a trie, one root for pieces at a word's start and one for pieces inside it. Each node has a
failure link and the number of pieces that greedy longest match gives up when it follows the link; both are computed once,
level by level. A word is then read one letter at a time, adding the popped counts, in time linear in its length. The
result is that of greedy longest match over the whole vocabulary, on the word with the word mark before it as a letter.

The vocabulary comes from a SentencePiece file given by path: pieces with the word mark start a word (the bare mark too: after it
the word goes on with any piece), and all may continue it; control pieces are left out. Where the file has the byte pieces, a
letter that no piece covers counts its UTF-8 bytes; where it has none, such a word is one unknown token (``n_unknown``
is therefore 0 for every text under a vocabulary with byte pieces). Words are what ASCII white space separates. Counts of recent words
are cached in a bounded table per worker.

Defined cases: null and empty texts have no words and no tokens. Repeated rows each get a row.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import text_of

WORD_MARK = "▁"
CACHE_WORDS = 200_000
_WORD = re.compile(r"[^ \t-\r]+")
_DEAD = -1
_TYPE = "n_words long, n_tokens long, n_unknown long"


class LongestMatch:
    """Trie with failure links; ``starts`` are the pieces at a word's start ('' is the bare mark), ``inner`` those inside it.
    ``byte_pieces``: letters without a piece count their UTF-8 bytes."""

    def __init__(self, starts: set[str], inner: set[str], byte_pieces: bool = False):
        self.next: list[dict[str, int]] = [{}, {}]   # node 0: start of a word; node 1: inside it
        self.byte_pieces = byte_pieces
        costs = [dict.fromkeys(starts, 1), dict.fromkeys(inner, 1)]
        if byte_pieces:
            costs[0].setdefault("", len(WORD_MARK.encode()))
            for c in {c for piece in starts | inner for c in piece}:
                costs[1].setdefault(c, len(c.encode()))
        final = [0, 0]                               # tokens of the piece that ends at a node
        for root, pieces in enumerate(costs):
            for piece, cost in pieces.items():
                node = root
                for c in piece:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        final.append(0)
                    node = self.next[node][c]
                final[node] = cost
        self.fail, self.popped = [_DEAD] * len(self.next), [0] * len(self.next)
        if final[0]:
            self.fail[0], self.popped[0] = 1, final[0]
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for c, child in self.next[node].items():
                    below.append(child)
                    if final[child]:
                        self.fail[child], self.popped[child] = 1, final[child]
                        continue
                    z, popped = self.fail[node], self.popped[node]
                    while z != _DEAD and c not in self.next[z]:
                        popped += self.popped[z]
                        z = self.fail[z]
                    if z != _DEAD:
                        self.fail[child], self.popped[child] = self.next[z][c], popped
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it cannot be cut."""
        node, total, step, fail, popped = 0, 0, self.next, self.fail, self.popped
        for c in word:
            while c not in step[node]:
                if node == 1 and self.byte_pieces:
                    total += len(c.encode())
                    break
                total += popped[node]
                node = fail[node]
                if node == _DEAD:
                    return 0
            else:
                node = step[node][c]
        while node != 1:
            total += popped[node]
            node = fail[node]
            if node == _DEAD:
                return 0
        return total


def _pieces(path: str) -> tuple[set[str], bool]:
    """Pieces of a SentencePiece file, and whether it has the byte pieces too."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return {model.id_to_piece(i) for i in known if not model.is_byte(i)}, sum(model.is_byte(i) for i in known) == 256


def vocabulary(path: str) -> tuple[set[str], set[str]]:
    """(pieces at a word's start without the mark, pieces inside it) of a SentencePiece file."""
    pieces, _ = _pieces(path)
    return {p[1:] for p in pieces if p.startswith(WORD_MARK)}, pieces


_loaded: dict[str, tuple[LongestMatch, dict[str, int]]] = {}


def automaton(path: str) -> tuple[LongestMatch, dict[str, int]]:
    """The automaton of a vocabulary file and its cache of words, once a process."""
    if path not in _loaded:
        _loaded[path] = LongestMatch(*vocabulary(path), _pieces(path)[1]), {}
    return _loaded[path]


def count_tokens(docs: DataFrame, vocabulary_path: str, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_tokens (an unknown word is one token) and n_unknown."""
    def of(texts: pa.Array) -> pa.Array:
        match, known = automaton(vocabulary_path)
        words, tokens, unknown = [], [], []
        for t in texts:
            n = total = lost = 0
            for w in _WORD.findall(t.as_py() or ""):
                c = known.get(w)
                if c is None:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    c = known[w] = match.count(w)
                n += 1
                total += c
                lost += not c
            words.append(n)
            tokens.append(total + lost)
            unknown.append(lost)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (words, tokens, unknown)], ["n_words", "n_tokens", "n_unknown"])

    return docs.withColumn(out, F.arrow_udf(of, _TYPE)(text_of(docs, text_col)))
