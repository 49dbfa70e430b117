"""Toxicity scores from the nearest labelled examples, by exact TF-IDF cosine over block-max inverted lists.

Learning: up to ``max_examples`` labelled texts of ``docs`` (a bounded, documented sample: those with the smallest hash of their id). Terms
are words and word beginnings of 4 to 6 bytes; kept are all that mark toxic examples: the one-sided exact test of Fisher on
presence counts, at ``LEVEL`` over all terms of toxic examples together (Bonferroni). The test holds at every share of toxic examples,
and no number of terms is set. One more term, present in every text, stands for the rest, so
that any two texts have a defined cosine. Document frequencies are counted over all texts of ``docs``.

Scoring: a text's weights are (1 + ln tf)(ln((1 + N) / (1 + df)) + 1), scaled to unit length. Equal example vectors are one
entry with counts. Each term has an inverted list cut into blocks of entries, with the largest weight of each block; blocks are
scored in the order of their upper bounds until no bound reaches the k-th best similarity. All entries that tie with the k-th count.
Votes are weighted by 1 / (distance + 0.05); an isotonic fit of leave-one-out votes of the examples calibrates the share of toxic
votes. Evidence: the ids of the nearest examples.

Defined cases: null and empty texts have only the shared term. Labels that are null, or of no document, teach nothing; a document
labelled twice takes the larger label, of repeated rows one is an example. Without any example every score is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._frames import free_name, stash, text_of
from ._words import ALNUM_LOWER, runs

MAX_EXAMPLES = 20_000
NEIGHBOURS = 15
BLOCK = 64
LEVEL = 0.01
STEMS = (4, 5, 6)
_TABLE = bytes(int(c) or 0x20 for c in ALNUM_LOWER)
_TYPE = "score double, predicted int, evidence array<long>"


def _terms(word: bytes) -> Iterator[bytes]:
    """A word itself and its beginnings, the latter marked by a star."""
    yield word
    for n in STEMS:
        if len(word) >= n:
            yield word[:n] + b"*"


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _count_terms(wanted=None):
    """Arrow task: texts -> (term, texts with it), summed over slices of a batch; ``wanted``: only these terms (a broadcast set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in runs(b.column(0)):
                counts: Counter = Counter()
                for text in b.column(0).slice(lo, hi - lo):
                    mine = {t for w in set(_split(text.as_py())) for t in _terms(w)}
                    counts.update(mine if wanted is None else mine & wanted.value)
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["term", "n"])

    return run


def _presence(texts: DataFrame, wanted=None) -> DataFrame:
    return texts.select(text_of(texts, "text")).mapInArrow(_count_terms(wanted), "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _log_tail(a: int, n: int, toxic: int, total: int) -> float:
    """Logarithm of the chance that ``a`` or more of ``n`` texts are toxic, drawn from ``total`` with ``toxic`` toxic ones."""
    log = lambda x: math.lgamma(x + 1)
    first = log(toxic) - log(a) - log(toxic - a) + log(total - toxic) - log(n - a) - log(total - toxic - n + a) - log(total) + log(n) + log(total - n)
    part = terms = 1.0
    for x in range(a, min(n, toxic)):
        part *= (toxic - x) * (n - x) / ((x + 1) * (total - toxic - n + x + 1))
        terms += part
        if part < 1e-12 * terms:
            break
    return first + math.log(terms)


def select_terms(examples: DataFrame, level: float = LEVEL) -> list[bytes]:
    """All terms that mark toxic examples, the surest first.

    Candidates are the terms of toxic examples that could pass if no clean example had them; only these are counted among all.
    """
    examples = examples.dropDuplicates(["text", "toxic"])  # copies of a text are one witness for its words
    total, toxic = examples.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic or toxic == total:
        return []
    found = stash(_presence(examples.where("toxic = 1")))
    bar = math.log(level / max(1, found.count()))
    least = next((a for a in range(1, toxic + 1) if _log_tail(a, a, toxic, total) <= bar), toxic + 1)
    candidates = {bytes(r.term): r.n for r in found.where(F.col("n") >= least).collect()}  # bounded by max_examples texts
    wanted = examples.sparkSession.sparkContext.broadcast(set(candidates))
    best = []
    for r in _presence(examples, wanted).collect():  # as many rows as candidates
        term, n = bytes(r.term), r.n
        a = candidates[term]
        if a * total > n * toxic and (tail := _log_tail(a, n, toxic, total)) <= bar:
            best.append((tail, term))
    return [term for _, term in sorted(best)]


class Vocabulary:
    """Selected terms; ``counts`` gives {term number: occurrences} of a text."""

    def __init__(self, terms: list[bytes]):
        self.number = {t: k for k, t in enumerate(terms)}
        self.short = min(STEMS)
        self.heads = {t.rstrip(b"*")[:self.short] for t in terms}

    def counts(self, text: str | None) -> dict[int, int]:
        heads, short, number, out = self.heads, self.short, self.number, {}
        for w in _split(text):
            if w[:short] in heads:
                for t in _terms(w):
                    k = number.get(t)
                    if k is not None:
                        out[k] = out.get(k, 0) + 1
        return out


@dataclass
class Model:
    """Block-max inverted index of the examples and the calibration of its votes."""

    vocabulary: Vocabulary
    idf: np.ndarray                # by term; the last is the shared term
    entries: np.ndarray            # examples, toxic examples of each entry (n x 2)
    ids: list[list[int]]           # some example ids of each entry
    lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # by term: entries, weights, first posting of each block
    most: np.ndarray               # by term and block: largest weight
    k: int
    curve: tuple[np.ndarray, np.ndarray]

    def vector(self, counts: dict[int, int]) -> list[tuple[int, float]]:
        w = [(t, (1 + math.log(n)) * self.idf[t]) for t, n in sorted(counts.items())] + [(len(self.idf) - 1, float(self.idf[-1]))]
        size = math.sqrt(sum(x * x for _, x in w))
        return [(t, float(x / size)) for t, x in w]

    def nearest(self, vector: list[tuple[int, float]], leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines) of the k nearest examples with all ties, nearest first. ``leave``: one example of this entry is left out."""
        terms = [t for t, _ in vector]
        bound = np.array([x for _, x in vector]) @ self.most[terms]
        size = self.entries[:, 0].copy()
        if leave >= 0:
            size[leave] -= 1
        at, sim = np.zeros(0, np.int64), np.zeros(0)
        least = -1.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] < least - 1e-12:
                break
            base, top = b * BLOCK, min((b + 1) * BLOCK, len(size))
            score = np.zeros(top - base)
            for t, x in vector:
                rows, weights, cut = self.lists[t]
                s = slice(cut[b], cut[b + 1])
                score[rows[s] - base] += x * weights[s]
            new = np.flatnonzero((score >= least - 1e-12) & (size[base:top] > 0))
            at, sim = np.concatenate([at, new + base]), np.concatenate([sim, np.round(score[new], 12)])
            order = np.lexsort((at, -sim))
            at, sim = at[order], sim[order]
            enough = np.searchsorted(np.cumsum(size[at]), self.k)
            if enough < len(at):
                least = sim[enough]
                at, sim = at[sim >= least], sim[sim >= least]
        return at, sim

    def vote(self, vector: list[tuple[int, float]], leave: int = -1, toxic: int = 0) -> tuple[float, np.ndarray]:
        at, sim = self.nearest(vector, leave)
        votes = self.entries[at].astype(float)
        if leave >= 0:
            votes[at == leave] -= (1, toxic)
        weight = 1 / (np.maximum(0, 1 - sim) + 0.05)
        total = float((weight * votes[:, 0]).sum())
        return (float((weight * votes[:, 1]).sum()) / total if total else 0.0), at

    def score(self, counts: dict[int, int]) -> tuple[float, list[int]]:
        if not len(self.entries):
            return 0.0, []
        raw, at = self.vote(self.vector(counts))
        fitted = float(np.interp(raw, *self.curve))
        return min(1.0, max(0.0, 0.98 * fitted + 0.02 * raw)), [i for e in at[:5].tolist() for i in self.ids[e]][:5]


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; each pool has half a toxic and half a clean vote more, so no pool is certain."""
    pools: list[list[float]] = []  # sum of x, sum of y, size
    for u, v in sorted(zip(x.tolist(), y.tolist())):
        if pools and pools[-1][0] / pools[-1][2] == u:
            pools[-1] = [pools[-1][0] + u, pools[-1][1] + v, pools[-1][2] + 1]
        else:
            pools.append([u, v, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.maximum.accumulate([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def build_model(terms: list[bytes], examples: list[tuple[int, dict[int, int], int]], frequencies: dict[int, int], total: int,
                k: int = NEIGHBOURS) -> Model:
    """``examples``: (id, term counts, toxic). ``frequencies``: texts with each term, of ``total`` texts."""
    idf = np.array([math.log((1 + total) / (1 + frequencies.get(t, 0))) + 1 for t in range(len(terms))] + [1.0])
    model = Model(Vocabulary(terms), idf, np.zeros((0, 2), np.int64), [], [], np.zeros((len(idf), 0)), k, (np.zeros(1), np.zeros(1)))
    groups: dict[tuple, list] = {}
    for i, counts, toxic in sorted(examples, key=lambda e: e[0]):
        g = groups.setdefault(tuple(model.vector(counts)), [0, 0, []])
        g[0] += 1
        g[1] += toxic
        g[2] += [i][:max(0, 5 - len(g[2]))]
    vectors = sorted(groups, key=lambda v: (max(v, key=lambda p: p[1])[0], v))  # entries with the same main term share blocks
    model.entries = np.array([groups[v][:2] for v in vectors], np.int64).reshape(-1, 2)
    model.ids = [groups[v][2] for v in vectors]
    postings: list[list[tuple[int, float]]] = [[] for _ in idf]
    for e, v in enumerate(vectors):
        for t, x in v:
            postings[t].append((e, x))
    blocks = -(-len(vectors) // BLOCK)
    model.most = np.zeros((len(idf), blocks))
    for t, p in enumerate(postings):
        rows, weights = np.array([e for e, _ in p], np.int64), np.array([x for _, x in p], float)
        model.lists.append((rows, weights, np.searchsorted(rows, np.arange(blocks + 1) * BLOCK)))
        np.maximum.at(model.most[t], rows // BLOCK, weights)
    if len(examples) > 1:
        raw, seen = [], []
        for e, v in enumerate(vectors):  # equal vectors with equal labels have equal votes
            n, toxic, _ = groups[v]
            for label, times in ((1, toxic), (0, n - toxic)):
                if times:
                    raw += [model.vote(list(v), e, label)[0]] * times
                    seen += [label] * times
        model.curve = _isotonic(np.array(raw), np.array(seen, float))
    return model


def _count_column(shared, text: Column) -> Column:
    def of(texts: pa.Array) -> pa.Array:
        counts = shared.value.counts
        return pa.array([list(counts(t.as_py()).items()) for t in texts], pa.map_(pa.int32(), pa.int32()))

    return F.arrow_udf(of, "map<int, int>")(text)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS) -> Model:
    """Model from ``labels`` (``id_col``, ``label_col`` 0 or 1); statistics over all of ``docs``."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna() \
        .groupBy("id").agg(F.max("toxic").alias("toxic")).join(texts.select("id"), "id", "left_semi") \
        .orderBy(F.xxhash64("id"), "id").limit(max_examples)
    # at most max_examples rows of two numbers
    examples = stash(texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]))
    terms = select_terms(examples)
    shared = spark.sparkContext.broadcast(Vocabulary(terms))
    rows = [(r.id, dict(r.counts), r.toxic) for r in
            examples.select("id", "toxic", _count_column(shared, F.col("text")).alias("counts")).collect()]
    found = texts.select(F.explode(F.map_keys(_count_column(shared, F.col("text")))).alias("term"))
    frequencies = {r.term: r["count"] for r in found.groupBy("term").count().collect()}  # a row a term
    return build_model(terms, rows, frequencies, texts.count(), k)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "toxicity",
                   model: Model | None = None, **options) -> DataFrame:
    """``docs`` with a struct column ``out``: score (0 to 1), predicted (score >= 0.5) and evidence (ids of nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, id_col, text_col, **options))

    def of(texts: pa.Array) -> pa.Array:
        m, known, scores, evidence = shared.value, {}, [], []
        for t in texts:
            counts = m.vocabulary.counts(t.as_py())
            key = tuple(sorted(counts.items()))
            if key not in known:
                known[key] = m.score(counts)
            s, ids = known[key]
            scores.append(s)
            evidence.append(ids)
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                                           pa.array(evidence, pa.list_(pa.int64()))], ["score", "predicted", "evidence"])

    return docs.withColumn(out, F.arrow_udf(of, _TYPE)(text_of(docs, text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document's labels are never learnt from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that the model holds toxic, columns unchanged."""
    out = free_name(docs, "_toxicity")
    return score_toxicity(docs, labels, id_col, text_col, out, **options).where(F.col(f"{out}.predicted") == 0).drop(out)
