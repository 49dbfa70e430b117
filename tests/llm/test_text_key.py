"""Rows without an id are told apart by their whole text, also where 32 bits of its hash are equal."""
import pytest
import xxhash

from ledgerline.llm import line_dedup as L
from ledgerline.llm import simhash as S
from ledgerline.llm.substring_dedup import remove_repeated_windows

RUN = ["a", "b", "c", "d"]
PAIRS = [(42918, 57279), (148764, 145149), (149345, 47306)]
text = lambda k: "\n".join([f"s{k}", *(["u", "v", "w"] if k % 2 else []), *RUN])
low = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) & 0xFFFFFFFF


@pytest.fixture(scope="module")
def rows():
    assert all(low(text(a)) == low(text(b)) for a, b in PAIRS)
    return [(1, "\n".join(RUN)), *((None, text(k)) for p in PAIRS for k in p)]


def test_near_dedup_keeps_clean_documents(docs_of, rows):
    label = len({S.fingerprint(t) for _, t in rows})
    assert S.drop_near_duplicates(docs_of(rows), max_bits=0).count() == label == len(rows)


def test_cuts_are_of_the_own_text(docs_of, rows):
    want = {t: "\n".join(x for x in t.split("\n") if x not in RUN) for i, t in rows if i is None}
    lines = {r.text: r.d.kept_text for r in L.remove_repeated_lines(docs_of(rows), out="d").collect() if r.doc_id is None}
    words = {r.text: r.d.kept_text for r in remove_repeated_windows(docs_of(rows), n=4, out="d").collect() if r.doc_id is None}
    assert lines == want
    assert words == {t: w.replace("\n", " ") for t, w in want.items()}
