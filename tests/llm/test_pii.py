import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerline.llm import pii as P
from ledgerline.llm import queries as Q

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def holds(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == 1:
        return all(int(p) <= 255 for p in s.split("."))
    if kind == 2:
        odd = [d * 2 if k % 2 else d for k, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in odd) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def base(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if holds(k, m[0]))


CASES = ["", "mail a.b+c@x-y.co.uk, b@c, @d.e, q@r.s@t.u x@.y z@a..b", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8.9 01.002.3.4 1..2.3.4 9.9.9",
         "4804441644475432 4804-4416 4447-5432 4804441644475433 1 2 3", "+1 (555) 123-4567 +49.30.1234567890123456 ++12345678901 +1 2",
         "é@ü.de ä.b@c.de\n", "0" * 5000, "1." * 3000, "a@" * 3000, "a@b.c@d.e.f@g.h", "4804441644475432-", "+" * 50 + "12345678 9", "x" * 200_000 + "@y.z",
         "١٢٣.1.2.3.4"]


def test_base_kinds_equal_their_patterns():
    rng = random.Random(3)
    cases = CASES + ["".join(rng.choice("a@.1234567890 -+()é") for _ in range(rng.randrange(60))) for _ in range(4000)]
    for t in cases:
        assert [s for s in P.find_spans(t) if s[1] < 4] == base(t), repr(t)


def test_added_kinds():
    found = lambda t: [(P.KINDS[k], t[a:b]) for a, k, b in P.find_spans(t) if k > 3]
    assert found("IBAN: DE89 3704 0044 0532 0130 00 thanks") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert found("iban GB82WEST12345698765432.") == [("account", "GB82WEST12345698765432")]
    assert found("IBAN: DE89 3704 0044 0532 0130 01") == []
    assert found("Account no. 12-345-678 and accounting 12345678") == [("account", "12-345-678")]
    assert found("see https://bob:pw1@host.example/x and http://plain.example/") == [("login", "bob:pw1")]


def test_secrets():
    found = lambda t: [t[a:b] for a, k, b in P.find_spans(t) if P.KINDS[k] == "secret"]
    assert found('er token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" th') == ["04dbebab91ab85687d33eeaaf9ac699e1188f962"]
    assert found("API_KEY: 'abcd-1234'; \"secret\": \"s3cr3t-value\"") == ["abcd-1234", "s3cr3t-value"]
    assert found("my_access_token=Zm9vYmFyYmF6cXV4MTIz.x9 rest") == ["Zm9vYmFyYmF6cXV4MTIz.x9"]
    assert found("Password: \"abc1\" token: wonderful secret = short1 tokens = \"0123456789\" mytoken = \"0123456789\" api key: \"plain words\"") == []
    assert found('token = "0123456789') == [] and found("token") == [] and found("token=" + "=" * 50_000) == []
    assert found("token = " * 20_000) == [] and found("token" + " " * 100_000 + '= "0123456789"') == []
    assert found("token=" * 3 + "0123456789abcdef") == ["token=token=0123456789abcdef"]
    assert found("token=" * 100_000) == [] and found("token=" * 100_000 + "1") == ["token=" * 99_999 + "1"]


def test_rows(docs_of):
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (3, "a@b.cd"), (3, "a@b.cd"), (4, "w " * 300_000 + "é 10.0.0.1"), (5, "Konto: 1234567890")]
    df = docs_of(rows).withColumn("start", F.lit(1)).withColumn("kind", F.lit("k"))
    got = P.find_personal_data(df, out="p")
    assert got.columns == [*df.columns, "p"]
    have = sorted((str(r.doc_id), [(s.kind, s.start, s["end"]) for s in r.p]) for r in got.collect())
    assert have == sorted([("1", []), ("2", []), ("None", [("email", 0, 6)]), ("3", [("email", 0, 6)]), ("3", [("email", 0, 6)]),
                           ("4", [("ip", 600_002, 600_010)]), ("5", [("account", 7, 17)])])
    clean = {str(r.doc_id): r.text for r in P.redact_personal_data(df).collect()}
    assert clean["1"] is None and clean["3"] == "[email]" and clean["5"] == "Konto: [account]"
    assert P.find_personal_data(df.limit(0)).count() == 0


def test_query(spark, real_texts):
    got = {r.doc_id: r for r in Q.op9_personal_data(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(real_texts)
    for i, t in real_texts:
        want, r = base(t), got[i]
        line = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
    assert sum(r.n_email for r in got.values())
