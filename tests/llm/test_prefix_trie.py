import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import prefix_trie as T
from ledgerline.llm import queries as Q

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_id(role, text):
    return hashlib.sha256(f"{len(role)}:{len(text)}:{role}:{text}".encode()).digest()[:16]


def conversations(rows):
    """conv -> [(role, text)] by turn, NULL first."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            out[c].append((t is not None, t or 0, role or "", turn_id(role or "", text or ""), text or ""))
    return {c: [(r[2], r[4]) for r in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    return {c: convs.get(c - c % 20, [])[:h[c]] + own[h[c]:] for c, own in convs.items()}


def trie(convs):
    """Nodes by brute force: every prefix of every conversation as a dictionary key."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        if p:
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def nodes(df):
    assert df.columns == COLUMNS
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def of(spark, rows, **options):
    turns = T.numbered_turns(spark.createDataFrame(rows, SCHEMA).withColumn("PLACE", F.lit("clash")).repartition(3))
    return T.prefix_trie(turns, turns.select("conv_id").distinct(), **options)


def hard(rng, n=40):
    """Long shared openings, copies, prefixes of other conversations, branches at every depth."""
    opening = [("user", f"opening {i}") for i in range(6)]
    paths = [opening[:rng.randrange(7)] + [("user", f"{rng.randrange(3)}") for _ in range(rng.randrange(4))] for _ in range(n)]
    paths += [opening + [("assistant", "same")]] * 30 + [[("user", f"first {rng.randrange(9)}"), ("tool", "x y")] for _ in range(n)]
    return [(c, t, role, text) for c, p in enumerate(paths) for t, (role, text) in enumerate(p)]


@pytest.mark.parametrize("limit", [1, 40, 100_000])
def test_bursts_change_no_node(spark, monkeypatch, limit):
    monkeypatch.setattr(T, "MAX_HEADS", 1 << 30)
    monkeypatch.setattr(T, "BLOCK", 16)
    rows = hard(random.Random(limit))
    assert nodes(of(spark, rows, limit=limit)) == trie(conversations(rows))


def test_heads_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(T, "MAX_HEADS", 5)
    rows = hard(random.Random(9))
    assert nodes(of(spark, rows, limit=1)) == trie(conversations(rows))


def test_edge_rows(spark):
    rows = [(5, 1, "user", "a b"), (5, None, None, None), (5, 1, "user", "a b"), (6, 1, "user", "a b"), (None, 1, "user", "lost"), (-3, 0, "user", "x " * 50_000),
            (7, None, "", ""), (7, 2, "user", "a b"), (7, 2, "user", "a b"), (8, 1, "use", "ra b")]
    assert nodes(of(spark, rows)) == trie(conversations(rows))
    turns = T.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    more = spark.createDataFrame([(c,) for c in (5, 6, -3, 7, 8, 100, 101)], "conv_id long")
    assert nodes(T.prefix_trie(turns, more)) == trie(conversations(rows) | {100: [], 101: []})
    assert T.prefix_trie(turns.limit(0), more.limit(0)).count() == 0


def test_branches(spark):
    rng = random.Random(4)
    rows = [(c, t, "user", f"{rng.randrange(2)}") for c in range(0, 130) if c not in (20, 41) for t in range(rng.randrange(5) if c % 20 else 2)]
    turns, convs = T.branched(T.numbered_turns(spark.createDataFrame(rows, SCHEMA)))
    want = trie(rebuilt(conversations(rows)))
    assert nodes(T.prefix_trie(turns, convs)) == want and nodes(T.prefix_trie(turns, convs, limit=3)) == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    rows = [tuple(r.values()) for r in pq.read_table(f"/root/testdata/{sf}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    assert nodes(Q.op12_conversation_trie(spark, f"/root/testdata/{sf}")) == trie(rebuilt(conversations(rows)))
