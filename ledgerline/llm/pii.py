"""Personal data by anchor expansion: an Aho-Corasick automaton finds anchors, local parsers set and check the borders.

Anchors are the at-sign, the scheme mark ``://``, a plus before a digit, digits, and words that announce an account number or a secret. One pass of the
automaton over a text yields them from left to right; each kind's parser expands from its anchor:

* ``email``: local part to the left of the at-sign, dotted labels to its right;
* ``ip``: four dotted numbers of at most 255, taken four by four along a dotted chain;
* ``card``: a chain of digits with single blanks or dashes between, 12 to 19 digits, Luhn check;
* ``phone``: plus, digits, blanks, brackets, dots and dashes up to the last digit, 9 to 15 digits;
* ``account`` (added by the method): after an announcing word, an IBAN with its check digits, or 6 to 20 digits;
* ``login`` (added by the method): user information in front of the host of a URL;
* ``secret`` (added by the method): after a whole announcing word (alone or at the end of a name such as ``api_key``) and ``=`` or ``:``, a value
  in quotes of at least 8 characters, or a bare one of at least 16; both hold a digit, so that prose after a colon is none. Announcing words inside a value are part of it.

The first four equal leftmost, non-overlapping matches of their patterns, in time linear in the text (parsers
do not look again at what they have passed). Offsets are code points, ends exclusive.

Defined cases: null and empty texts have no spans; kinds may overlap each other; repeated rows each get a row.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "login", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?:[ \t]*(?:no|nr|num|number|nummer)\b\.?)?[ \t:#=.]{1,4}(?:([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})|([0-9](?:[ -]?[0-9]){5,19}))(?![A-Za-z0-9])", re.I)
_LOGIN = re.compile(r"[^\s/?#@<>\"']++@[A-Za-z0-9.-]+")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
# Words that announce an account number.
CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta")
# Words that announce a secret, as whole words or at the end of a name.
SECRETS = ("token", "secret", "password", "passwd", "apikey", "api key", "api_key", "api-key", "access_key", "private_key")
_SECRET = re.compile(r"[\"']?[ \t]{0,8}[:=][ \t]{0,8}(?:\"([^\s\"]{8,})\"|'([^\s']{8,})'|([A-Za-z0-9_~+/=.-]{16,}))")
_SPANS = "array<struct<kind string, start int, end int>>"


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for sign in ("@", "://", "+"):
        a.add_word(sign, sign)
    for digit in "0123456789":
        a.add_word(digit, "0")
    for cue in CUES:
        for form in (cue, cue.title(), cue.upper()):
            a.add_word(form, "cue")
    for cue in SECRETS:
        for form in (cue, cue.title(), cue.upper()):
            a.add_word(form, "secret" + str(len(cue)))
    a.make_automaton()
    return a


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) << (k & 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def iban(s: str) -> bool:
    """ISO 7064 check of an IBAN, blanks ignored."""
    s = s.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _email(text: str, at: int, low: int) -> tuple[int, int] | None:
    start = at
    while start > low and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _addresses(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """IP addresses of the dotted chain that starts at ``at``, and the chain's end."""
    chain = _DOTTED.match(text, at)
    parts, start, out = chain[0].split("."), at, []
    for k in range(0, len(parts) - 3, 4):
        four = parts[k:k + 4]
        size = sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
            out.append((start, start + size))
        start += size + 1
    return out, chain.end()


def _account(text: str, after: int) -> tuple[int, int] | None:
    m = _ACCOUNT.match(text, after)
    if m is None:
        return None
    if m[1]:
        s = m[1]
        while len(s.replace(" ", "")) >= 15:  # words of letters may follow an IBAN that is grouped by blanks
            if iban(s):
                return m.start(1), m.start(1) + len(s)
            s = s[:s.rindex(" ")].rstrip() if " " in s else ""
        return None
    return m.span(2)


def _secret(text: str, start: int, after: int) -> tuple[int, int, bool] | None:
    """The value behind the announcing word of text[start:after], and whether it holds a digit."""
    if start and text[start - 1].isalnum():
        return None
    m = _SECRET.match(text, after)
    return m and (*m.span(m.lastindex), any("0" <= c <= "9" for c in m[m.lastindex]))


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span, by start and kind."""
    out: list[tuple[int, int, int]] = []
    email_end = dotted_end = card_end = secret_end = 0
    for last, what in _ANCHORS.iter(text or ""):
        if what == "0":
            if last >= dotted_end:
                found, dotted_end = _addresses(text, last)
                out += [(a, 1, b) for a, b in found]
            if last >= card_end:
                m = _CARD.match(text, last)
                if m:
                    card_end, number = m.end(), _digits(m[0]) if m.end() - last < 64 else ""
                    if 12 <= len(number) <= 19 and luhn(number):
                        out.append((last, 2, card_end))
        elif what == "@":
            found = _email(text, last, email_end)
            if found:
                email_end = found[1]
                out.append((found[0], 0, email_end))
        elif what == "+":
            m = _PHONE.match(text, last)
            if m and 9 <= len(_digits(m[0])) <= 15:
                out.append((last, 3, m.end()))
        elif what == "://":
            scheme = _SCHEME.search(text, max(0, last - 22), last - 2)
            m = _LOGIN.match(text, last + 1) if scheme else None
            if m:
                out.append((last + 1, 5, last + 1 + m[0].index("@")))
        elif what.startswith("secret"):
            found = _secret(text, last + 1 - int(what[6:]), last + 1) if last >= secret_end else None
            if found:
                secret_end = found[1]
                if found[2]:
                    out.append((found[0], 6, secret_end))
        elif not (last + 1 < len(text) and text[last + 1].isalpha()):
            found = _account(text, last + 1)
            if found:
                out.append((found[0], 4, found[1]))
    return sorted(set(out))


def find_personal_data(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with an array column ``out`` of (kind, start, end), by start and kind."""
    def of(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_spans(t.as_py())] for t in texts]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return docs.withColumn(out, F.arrow_udf(of, _SPANS)(text_of(docs, text_col)))


def redact_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span (overlapping ones joined) replaced by its first kind in square brackets; columns unchanged."""
    def of(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            raw, parts, at = t.as_py(), [], 0
            for a, k, b in find_spans(raw):
                if a >= at:
                    parts += [raw[at:a], f"[{KINDS[k]}]"]
                at = max(at, b)
            rows.append("".join([*parts, raw[at:]]) if parts else raw)
        return pa.array(rows, pa.string())

    return docs.withColumn(text_col, F.arrow_udf(of, "string")(text_of(docs, text_col)))
