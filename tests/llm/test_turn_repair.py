import hashlib
import itertools
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import queries as Q
from ledgerline.llm import turn_repair as T

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def digest(text):
    return hashlib.sha256(f"{len(text)}:{text}".encode()).digest()[:16]


def damage(rows):
    """The contract's faults, row by row."""
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (c, t))
        kind = zlib.crc32(name.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        yield from [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, edits, repaired) going forward: by what the initials so far stand for ('', 's', 'u', 'ua'), the cheapest and then ASCII-least."""
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "ua", ("ua", "u"): "u"}

    def offer(best, key, value):
        if key not in best or value[:2] < best[key][:2]:
            best[key] = value

    def with_inserts(best):
        for _ in range(2):
            for key, (cost, audit, made) in list(best.items()):
                for role in ("user", "assistant"):
                    if (key, role[0]) in follows:
                        offer(best, follows[key, role[0]], (cost + 2, audit + "I", (made, (role, ""))))
        return best

    best = with_inserts({"": (0, "", None)})
    for (role, text), fault in zip(rows, found):
        after = {}
        for key, (cost, audit, made) in best.items():
            offer(after, key, (cost + 3, audit + "D", made))
            if fault not in ("blank", "duplicate"):
                price = cost + (fault == "truncated")
                if (key, role[:1]) in follows:
                    offer(after, follows[key, role[:1]], (price, audit + "K", (made, (role, text))))
                for new in ("user", "assistant"):
                    if (key, new[0]) in follows:
                        offer(after, follows[key, new[0]], (price + 2, audit + "R", (made, (new, text))))
        best = with_inserts(after)
    cost, audit, made = min((best[k] for k in ("", "ua") if k in best), key=lambda v: v[:2])
    turns = []
    while made:
        made, last = made
        turns.insert(0, last)
    return cost, audit, turns


def whole_search(rows, found):
    """Every sequence of edits of at most len(rows) + 2 inserts, without any table."""
    out = []
    for n in range(len(rows) + 3):
        for spots in itertools.combinations(range(len(rows) + n), n):
            for choice in itertools.product(*[("I",) if k in spots else "DKR" for k in range(len(rows) + n)]):
                for added in itertools.product(("user", "assistant"), repeat=sum(c in "IR" for c in choice)):
                    added, left, cost, made = list(added), list(zip(rows, found)), 0, []
                    for c in choice:
                        (role, text), fault = left.pop(0) if c != "I" else (("", ""), "")
                        if c in "KR" and fault in ("blank", "duplicate"):
                            break
                        cost += {"I": 2, "D": 3, "K": 0, "R": 2}[c] + (c in "KR" and fault == "truncated")
                        if c != "D":
                            made.append((role if c == "K" else added.pop(0), text))
                    else:
                        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in made)):
                            out.append((cost, "".join(choice), made))
    return min(out, key=lambda v: v[:2])


def expected(rows):
    """Report per conversation of damaged or other rows (conv, turn, role, text)."""
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == c and r[2] is not None), key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))
        own = [(role, text) for _, role, text in mine]
        found = faults(own)
        turns = {t for t, _, _ in mine if t is not None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, made = cheapest(own, found)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def reports(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_table_equals_search_of_all_edits():
    rng = random.Random(7)
    for n in (0, 1, 2, 2, 3, 3, 3):
        for _ in range(12):
            rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["", "x", "a.", "b!"])) for _ in range(n)]
            found = faults(rows)
            assert cheapest(rows, found) == whole_search(rows, found)


def test_edits_equal_the_table_at_every_block_size():
    rng = random.Random(8)
    for n in [*range(12), 30, 99, 400]:
        for _ in range(20):
            rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["", "x", f"{rng.random()}.", "b!"])) for _ in range(n)]
            found = faults(rows)
            codes = bytes("sua?".find(r[0]) & 3 | {"": 0, "blank": 4, "duplicate": 8, "truncated": 16}[f] for (r, _), f in zip(rows, found))
            audit = "".join(e for e, _ in T.tight_edits(codes))
            assert audit == cheapest(rows, found)[1], (rows, found)
            assert sum(c != "I" for c in audit) == n


def test_rows(spark):
    same = [(1, None, "user", "Hi."), (1, 3, "user", "Hi."), (1, 3, "assistant", "No"), (1, 9, "assistant", "Yes?  \n")]
    rows = [*same, (2, 0, "system", "S."), (2, 1, "user", " \t"), (3, 5, "user", "x." * 40_000), (4, None, None, None), (4, None, "", "q."),
            (5, 1, "user", "a."), (5, 1, "user", "a."), (5, 1, "assistant", "b."), (5, 1, "assistant", "a."), (None, 1, "user", "u."), (None, 2, "assistant", "v.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("Kind", F.lit("kept out")).withColumn("seq", F.lit(1)).repartition(3)
    extra = spark.createDataFrame([(77,), (1,), (None,)], "conv_id long")
    plain = [(c, t, role or "", text or "") for c, t, role, text in rows] + [(77, None, None, None)]
    assert reports(T.repair_reports(T.repair_turns(df, also=extra))) == expected(plain)
    turns = T.repair_turns(df).where("conv_id = 1 and seq is not null").orderBy("seq").select("edit", "role", "text").collect()
    assert [tuple(r) for r in turns] == [("K", "user", "Hi."), ("K", "assistant", "No"), ("I", "user", ""), ("K", "assistant", "Yes?  \n")] or \
        "".join(r.edit for r in turns if r.edit != "D") == reports(T.repair_reports(T.repair_turns(df)))[1][6].replace("D", "")
    empty = T.repair_reports(T.repair_turns(df.limit(0), also=extra.limit(0)))
    assert empty.count() == 0
    only = reports(T.repair_reports(T.repair_turns(df.limit(0), also=extra)))
    assert only == {k: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in (77, 1, None)}


def test_one_long_conversation_and_many_batches(spark):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["same.", f"text {t}", f"line {t}!", " "])) for t in range(2000)]
    rows += [(2 + t % 40, t, rng.choice(["user", "assistant"]), f"t{t}.") for t in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        assert reports(T.repair_reports(T.repair_turns(df))) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    rows = [tuple(r.values()) for r in pq.read_table(f"/root/testdata/{sf}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    want = expected([*damage(rows), *((c, None, None, None) for c in {r[0] for r in rows})])
    assert reports(Q.op13_conversation_repair(spark, f"/root/testdata/{sf}")) == want
    assert len(want) == len({r[0] for r in rows})
