"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, URL schemes and cues of identifiers. From
each anchor a local parser expands to the boundaries of what it may stand for, and validates it. All parsers
are linear in the text: no anchor looks at characters that another anchor of its kind has consumed.

The first four kinds are those of the regular expressions below, leftmost and without overlap in a kind, and
matches that fail their test are dropped without another try:

  email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
  ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)      every part at most 255
  card   [0-9]([\\x20-]?[0-9])+                      13 to 19 digits that pass Luhn
  phone  \\+[0-9][\\x20().0-9-]+[0-9]                 9 to 15 digits

Matches of ip, card and phone consist of [0-9.\\x20()+-], so they lie in runs of these characters, which are
what a digit expands to. The method adds: url (scheme, user information and host), account (IBAN of any
country that passes mod 97, numbers after an account cue, social security numbers after theirs; "no", "nr",
"number" or "id" may follow a cue in any case) and secret (values after
a password or token cue, access key ids). User information has any length, and so has a value: 8
characters or more, one of them a digit, bare or between equal quotes. A url's path ends before the marks
that close a sentence or a bracket.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import prepare

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEMES = ("http", "https", "ftp", "sftp", "ssh", "postgres", "mysql", "mongodb", "redis", "amqp")
ACCOUNT, SOCIAL, SECRET = ("account", "acct", "konto", "cuenta", "compte"), ("ssn", "social security"), ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
RUN = re.compile(r"[0-9.\x20()+-]+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+([0-9][\x20().0-9-]+)")
HOST = re.compile(r"([A-Za-z0-9._~%!$&'()*+,;=:-]++@)([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)(:[0-9]{1,5})?([/?#][^\s\"'<>]*)?")
CLOSING = ".,;:!?)]}"
QUALIFIER = r"(?:\s?(?i:no|nr|number|id))?\.?\s?[:#=]?\s?"
NUMBER = re.compile(QUALIFIER + r"([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])")
SSN = re.compile(QUALIFIER + r"((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])")
GIVEN = re.compile(r"\s{0,2}[:=]\s{0,2}([\"']?)")
VALUE = re.compile(r"([A-Za-z0-9_+/=.-]*[0-9])?[A-Za-z_+/=.-]*")  # the group ends behind the last digit
KEY_ID = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("email", 1))
    for s in ("://",):
        found.add_word(s, ("url", len(s)))
    for kind, cues in (("account", ACCOUNT), ("ssn", SOCIAL), ("secret", SECRET)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                found.add_word(form, (kind, len(form)))
    for c in ("AKIA", "ASIA"):
        found.add_word(c, ("key", 4))
    for a, b, k in itertools.product(CAPITALS, CAPITALS, "0123456789"):
        found.add_word(f"{a}{b}{k}", ("iban", 3))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _numbers(text: str, start: int, stop: int, out: list) -> None:
    """ip, card and phone in a run of their characters."""
    if stop - start < 7:
        return
    for m in CHAIN.finditer(text, start, stop):
        place, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (x.lstrip("0") for x in four)):
                out.append(("ip", place, place + size))
            place += size + 1
    for m in CARD.finditer(text, start, stop):
        if 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    place = start
    while m := PHONE.search(text, place, stop):
        got = m[1].rstrip(" ().-")
        place = m.start() + 1 + len(got)
        if len(got) < 3:  # the middle holds a character at least
            place = m.end()
        elif 9 <= len(_digits(got)) <= 15:
            out.append(("phone", m.start(), place))


def _left(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in LOCAL:
        at -= 1
    return at


def _scheme(text: str, at: int) -> int | None:
    start = at
    while start > 0 and at - start < 8 and "a" <= text[start - 1].lower() <= "z":
        start -= 1
    return start if text[start:at].lower() in SCHEMES else None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind as in KINDS, then start; offsets count code points, the end is exclusive."""
    out, mail, runs, url, account, secret = [], 0, 0, 0, 0, 0
    value, digit = 0, 0  # where the last run of a value's characters ends, and its last digit
    for last, (kind, size) in _automaton().iter(text or ""):
        stop, start = last + 1, last + 1 - size
        if kind == "digit":
            if start >= runs:
                begin = start - 1 if start and text[start - 1] == "+" and start - 1 >= runs else start
                runs = RUN.match(text, begin).end()
                _numbers(text, begin, runs, out)
        elif kind == "email":
            if start >= mail and (m := DOMAIN.match(text, stop)) and (begin := _left(text, start, mail)) < start:
                mail = m.end()
                out.append(("email", begin, mail))
        elif kind == "url":
            begin = _scheme(text, start)
            if begin is not None and begin >= url and (m := HOST.match(text, stop)):
                url = m.end()
                out.append(("url", begin, m.start(4) + len(m[4].rstrip(CLOSING)) if m[4] else url))
        elif kind == "iban":
            if start >= account and (start == 0 or not text[start - 1].isalnum()) and (m := IBAN.match(text, start)):
                whole = m[0].replace(" ", "")
                if 15 <= len(whole) <= 34 and int("".join(str(int(c, 36)) for c in whole[4:] + whole[:4])) % 97 == 1:
                    account = m.end()
                    out.append(("account", start, account))
        elif kind in ("account", "ssn"):
            if stop >= account and (m := (NUMBER if kind == "account" else SSN).match(text, stop)):
                account = m.end(1)
                out.append(("account", m.start(1), account))
        elif kind == "key":
            if start >= secret and (start == 0 or not text[start - 1].isalnum()) and (m := KEY_ID.match(text, start)):
                secret = m.end()
                out.append(("secret", start, secret))
        elif stop >= secret and (m := GIVEN.match(text, stop)):
            begin = m.end()
            if begin >= value:  # else a cue within that run: its value is the rest of it
                run = VALUE.match(text, begin)
                value, digit = run.end(), run.end(1)
            if value - begin >= 8 and digit > begin and text.startswith(m[1], value):
                secret = value
                out.append(("secret", begin, secret))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def _scan(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in found:
        rows = []
        for text in b.column(1).to_pylist():
            spans = find(text)
            base = [s for s in spans if s[0] in BASE]
            n = [sum(s[0] == k for s in base) for k in BASE]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), len(spans)))
        cols = list(zip(*rows)) or [[]] * 8
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))], names=[x.split()[0] for x in SCHEMA.split(", ")])


def detect(docs: DataFrame) -> DataFrame:
    """One row a document: counts and digest of the base spans, all spans, how many of them the method adds, and their number.

    A null or empty text has no spans, so its digest is that of the empty string. Repeated rows give repeated
    rows, an empty table gives none, and columns other than doc_id and text are ignored. No shuffle.
    """
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first and longest stays."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])
