import hashlib
import random

from pyspark.sql import functions as F

from ledgerline.llm import line_dedup as L
from ledgerline.llm import queries as Q

LAST = 2 ** 63 - 1


def brute(rows):
    """{(id, text): (kept text, lines, removed)} from the fingerprints, with matches extended over the texts' own lines."""
    docs = {}
    for i, t in rows:
        docs[LAST if i is None else i, t] = [x.strip() for x in (t or "").split("\n") if x.strip()]
    first = {}
    for (i, t), ls in docs.items():
        for h, k, _, _ in L.fingerprints(t):
            first[h] = min(first.get(h, (i, k, t or "")), (i, k, t or ""))
    out = {}
    for (i, t), ls in docs.items():
        gone = set()
        for h, k, long, _ in L.fingerprints(t):
            j, p, u = first[h]
            if (i, k) <= (j, p):
                continue
            other = docs.get((j, u)) if (j, u) in docs else docs[j, None]
            a = b = 0
            while a < 4 and k + a < len(ls) and p + a < len(other) and ls[k + a] == other[p + a]:
                a += 1
            while b < 2 and k - b > 0 and p - b > 0 and ls[k - b - 1] == other[p - b - 1]:
                b += 1
            if a >= 1 and (long or (a >= 2 and a + b >= 3)):
                gone.update(range(k - b, k + a))
        kept, n, last = [], -1, False
        for x in (t or "").split("\n"):
            if x.strip():
                n += 1
                last = n in gone
            if not last:
                kept.append(x)
        out[i, t] = ("\n".join(kept) if gone else t, len(ls), len(gone))
    return out


def check(df, rows):
    want = brute(rows)
    got = L.remove_repeated_lines(df, out="d").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r.d) == want[LAST if r.doc_id is None else r.doc_id, r.text]
    return want


LONG = " ".join(f"l{k}" for k in range(55))
SHORT = "\n".join(f"line {k}" for k in range(6))


def test_edge_rows(docs_of):
    rows = [(1, SHORT), (2, "own\n\n" + SHORT + "\n\ntail"), (3, None), (4, ""), (5, "\n \n"), (6, LONG), (7, "a\n" + LONG + "\nb"),
            (7, "a\n" + LONG + "\nb"), (None, SHORT), (8, "line 0\nline 1\nother"), (9, "x\ny\nx\ny\nx\ny"), (10, "  line 2 \nline 3\r\nline 4\nq"),
            (11, "same\n" * 9), (12, "q\n" * 40_000), (13, "é " * 400_000), (14, "one"), (15, "one")]
    want = check(docs_of(rows), rows)
    assert want[2, rows[1][1]] == ("own\n\ntail", 8, 6)
    assert want[7, rows[6][1]] == ("a\nb", 3, 1)
    assert want[LAST, SHORT] == ("", 6, 6)
    assert want[8, rows[9][1]][2] == 0 and want[15, "one"][2] == 0


def test_shared_runs_of_three_lines_are_found(docs_of):
    rng = random.Random(7)
    rows, planted = [], {}
    for k in range(60):
        run = [f"run {k} {j}" for j in range(rng.randrange(3, 9))]
        own = lambda: [f"own {rng.random()}" for _ in range(rng.randrange(0, 7))]
        rows.append((k, "\n".join(own() + run + own())))
        a, b = own(), own()
        rows.append((1000 + k, "\n".join(a + run + b)))
        planted[1000 + k] = "\n".join(a + b)
    want = check(docs_of(rows, 4), rows)
    for (i, _), (kept, _, removed) in want.items():
        assert kept == planted[i] if i >= 1000 else removed == 0


def test_random_lines(docs_of):
    rng = random.Random(8)
    rows = [(k, "\n".join(rng.choice("abcdefg") for _ in range(rng.randrange(12)))) for k in range(120)]
    check(docs_of(rows, 5), rows)


def test_empty_and_clashing(docs_of):
    assert L.remove_repeated_lines(docs_of([(1, "a")]).limit(0)).count() == 0
    df = docs_of([(1, SHORT), (2, SHORT)]).withColumn("pos", F.lit(1)).withColumn("_runs", F.lit("r")).withColumn("near", F.lit(0))
    got = L.remove_repeated_lines(df, out="d")
    assert got.columns == [*df.columns, "d"] and {(r.doc_id, r.d.n_removed) for r in got.collect()} == {(1, 0), (2, 6)}


def test_query(spark, real_texts):
    want = {(i, n, g, None if k is None else hashlib.sha256(k.encode()).hexdigest()) for (i, _), (k, n, g) in brute(real_texts).items()}
    got = Q.op4_line_dedup(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(real_texts) and set(map(tuple, got)) == want
    assert any(w[2] for w in want)


def exact(rows, min_lines=3):
    """{(id, text): numbers of the lines in runs that occur earlier}, by comparing the lines of all runs, without fingerprints."""
    docs = {(i, t): [x.strip() for x in (t or "").split("\n") if x.strip()] for i, t in rows}
    counts = lambda run: len(run) == min_lines or len(run) < min_lines and sum(len(x.split()) for x in run) >= 50
    windows = [(i, k, t, tuple(ls[k:k + n])) for (i, t), ls in docs.items() for n in range(1, min_lines + 1)
               for k in range(len(ls) - n + 1) if counts(ls[k:k + n])]
    first, gone = {}, {d: set() for d in docs}
    for i, k, _, run in windows:
        first[run] = min(first.get(run, (i, k)), (i, k))
    for i, k, t, run in windows:
        if (i, k) > first[run]:
            gone[i, t].update(range(k, k + len(run)))
    return gone


def check_exact(df, rows):
    want = exact(rows)
    for r in L.remove_repeated_lines(df, out="d").collect():
        kept = [x.strip() for x in r.d.kept_text.split("\n") if x.strip()]
        lines = [x.strip() for x in r.text.split("\n") if x.strip()]
        assert kept == [x for k, x in enumerate(lines) if k not in want[r.doc_id, r.text]], r.doc_id
    return want


def test_run_whose_parts_occur_earlier_elsewhere(docs_of):
    run = [f"part {k}" for k in range(6)]
    rows = [(k, f"own {k}\n{run[k]}\n{run[k + 1]}\nend {k}") for k in range(5)] + [(i, "\n".join([f"a {i}", *run, f"b {i}"])) for i in (10, 11, 12)]
    want = check_exact(docs_of(rows), rows)
    assert [sorted(want[r]) for r in rows] == [[]] * 6 + [[1, 2, 3, 4, 5, 6]] * 2


def test_all_runs_of_random_lines(docs_of):
    rng = random.Random(9)
    line = lambda: rng.choice("abcdefg") if rng.random() < 0.8 else LONG + rng.choice("xyz")
    rows = [(k, "\n".join(line() for _ in range(rng.randrange(1, 15)))) for k in range(150)]
    assert any(check_exact(docs_of(rows, 4), rows).values())


def test_two_lines_of_fifty_words(docs_of):
    a, b, c = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("a", 23), ("b", 46), ("c", 26)))
    rows = [(1, f"p\n{a}\n{b}\nq"), (2, f"r\n{a}\n{b}\ns"), (3, f"{a}\n{c}\nt"), (4, f"{a}\n{c}\nu")]
    want = check_exact(docs_of(rows), rows)
    assert [sorted(want[r]) for r in rows] == [[], [1, 2], [], []]


def test_every_window_has_its_fingerprint_and_equal_windows_the_same():
    rng = random.Random(5)
    line_of = {}
    for _ in range(300):
        text = "\n".join(rng.choice("abcdefg") if rng.random() < 0.8 else LONG + rng.choice("xyz") for _ in range(rng.randrange(15)))
        lines, (hashes, chosen) = text.split("\n"), L.winnow(text)
        assert sorted((h, k, n) for mine in chosen.values() for h, k, n in mine) == sorted((h, k, n) for h, k, _, n in L.fingerprints(text))
        for at, mine in chosen.items():
            for h, k, n in mine:
                assert k <= at < k + n and line_of.setdefault(h, lines[at]) == lines[at]
    texts = [f"unique {rng.random()}" for _ in range(2000)]
    assert len(L.winnow("\n".join(texts))[1]) < 0.6 * len(texts)       # about half of the lines are fingerprints


def test_texts_of_one_id_are_ordered_by_their_hash(docs_of):
    got = [r.d.n_removed for r in L.remove_repeated_lines(docs_of([(None, SHORT), (None, SHORT + "\nmore"), (None, "x\n" + SHORT)]), out="d").collect()]
    assert sorted(got) == [0, 6, 6]
