"""Operator 6: personal data by base patterns and boosted trees over candidate spans.

Base patterns (e-mail, IPv4, payment card, international phone) always stand. Beside them, high-recall
generators propose candidates that may overlap in any way: every run of digit groups of a plausible
length under every kind it could be (card, phone, account, identity number), spelled-out e-mail addresses,
disguised IP addresses, IBAN-like strings, and mixed strings that could be secrets. Gradient-boosted trees score
each from its format and context. Each kind has a threshold of its own, calibrated on held-out documents into which another
generator wrote: other formats, other words before them, other look-alikes (``calibrated``). Of overlapping candidates the best scored one stays (of equal ones the first, the
shorter, the first by kind); none that overlaps a base span does.

The trees are trained with Spark ML on every document: those whose text's hash is divisible by four calibrate, all others are
learned from. No labels exist, so the classes are made: ``DRAWS`` times examples are written, of every kind in many
formats (positive) and of what looks alike but is none: dates, years, amounts, versions, checksums, book
numbers, time stamps, spoiled check digits (negative), with and without words that announce them. Each is put at every
place of every text, a place being where a word begins. All that an example's features take from its place is whether a word that
announces its kind, or something else, stands in the ``WINDOW`` characters before, and whether a colon or equals sign does; so
one pass counts the places of all texts by these (``contexts``), and an example is learned once for each such
context, weighted by the number of its places. Every base span is rewritten in place as well. A document weighs ``PLACES`` by its places together,
and one by each rewriting. What the generators find in the documents themselves has no
label and takes part in neither training nor calibration. Scoring reads whole texts in one narrow step: a
model of some hundred nodes is sent, no row is.

Offsets are code points, end exclusive. Cases: a null or empty text has no spans; repeated rows have
equal results; without a text to learn from there is no model and no added span; an
empty table gives no rows. Result columns replace columns of the same name, others pass through.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain.llm.columns import pack, unpack
from pagegrain.sources.pages import spread
from pagegrain.storage import stash

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "identity", "secret")
DRAWS = 1600
PLACES = 4
WINDOW = 32
PIECE = 1 << 20
PRECISION, RECALL = 0.98, 0.99
TREES, DEPTH = 16, 5
FIT_TASKS, FIT_ROWS = 8, 250_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_GROUP = re.compile(r"[0-9]+")
_WORD = re.compile(r"\S+")
_COLON = re.compile(r"[:=][ \"']+")
_JOIN = re.compile(r"[\x20().\-/]{1,3}")
_DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])")
_SPELLED = re.compile(r"([A-Za-z0-9._%+-]{1,64})(\x20?[\(\[]at[\)\]]\x20?|\x20at\x20|@)([A-Za-z0-9-]{1,63}(?:(?:\x20?[\(\[]dot[\)\]]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63})+)")
_AT = re.compile(r"[\(\[]at[\)\]]|\x20at\x20(?=[A-Za-z0-9-]{1,63}\x20dot\x20)")
_MIXED = re.compile(r"[A-Za-z0-9_+/\-]{12,}={0,2}")
_ASSIGNED = re.compile(r"[:=]\x20?[\"']?([^\s\"',;]{6,})")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_HINTS = {
    "email": re.compile(r"e-?mail|contact|write", re.I), "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|visa|credit|payment", re.I), "phone": re.compile(r"phone|tel|call|mobile|fax", re.I),
    "account": re.compile(r"account|acct|iban|customer|member|konto|cuenta|compte", re.I), "identity": re.compile(r"ssn|social security|passport|tax|iban|\bid\b", re.I),
    "secret": re.compile(r"token|secret|passw|pwd|api.?key|access.?key|\bkeys?\b|credential|auth|bearer", re.I),
}
_OTHER = re.compile(r"isbn|ean|commit|sha|md5|checksum|uuid|version|page|since|from|between|order|total|units|date|file|http|doi", re.I)
#: How the matches of these begin, in lower case: to find them all in whole texts without trying a pattern at each character.
_BEGIN = {
    _HINTS["email"]: ("email", "e-mail", "contact", "write"), _HINTS["ip"]: ("ip", "host", "server", "address"), _HINTS["card"]: ("card", "visa", "credit", "payment"),
    _HINTS["phone"]: ("phone", "tel", "call", "mobile", "fax"), _HINTS["account"]: ("account", "acct", "iban", "customer", "member", "konto", "cuenta", "compte"),
    _HINTS["identity"]: ("ssn", "social security", "passport", "tax", "iban", "id"), _HINTS["secret"]: ("token", "secret", "passw", "pwd", "api", "access", "key", "credential", "auth", "bearer"),
    _OTHER: ("isbn", "ean", "commit", "sha", "md5", "checksum", "uuid", "version", "page", "since", "from", "between", "order", "total", "units", "date", "file", "http", "doi"),
}

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType()),
]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_END.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """The base patterns' matches, leftmost and non-overlapping for each kind, that pass their checks."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _numbers(text: str) -> Iterator[Span]:
    """Every run of neighbouring digit groups of 7 to 19 digits, under each kind of that length."""
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(text)]
    for i, (a, _) in enumerate(groups):
        digits, to = 0, a
        for k in range(i, len(groups)):
            s, e = groups[k]
            if k > i and not _JOIN.fullmatch(text, to, s):
                break
            digits, to = digits + e - s, e
            if digits > 19:
                break
            if digits < 7:
                continue
            begin = a - 1 if a and text[a - 1] in "+(" else a
            if digits <= 15:
                yield "phone", begin, e
            if digits == 9 and k > i:
                yield "identity", a, e
            if digits >= 8:
                yield "account", a, e
            if digits >= 12:
                yield "card", a, e


def candidates(text: str) -> list[Span]:
    """Everything that might be personal data; spans may overlap."""
    found: set[Span] = set()
    if _DIGIT.search(text):
        found.update(_numbers(text))
        found.update(("ip", m.start(), m.end()) for m in _DOTTED.finditer(text))
        found.update(("identity", m.start(), m.end()) for m in _IBAN.finditer(text))
        for m in _MIXED.finditer(text):
            if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
                found.add(("secret", m.start(), m.end()))
    if ":" in text or "=" in text:
        found.update(("secret", *m.span(1)) for m in _ASSIGNED.finditer(text) if _HINTS["secret"].search(text, max(0, m.start() - 24), m.start()))
    if "@" in text or _AT.search(text):
        for at in [m.start() for m in re.finditer("@", text)] + [m.start() for m in _AT.finditer(text)]:
            for m in _SPELLED.finditer(text, max(0, at - 66), min(len(text), at + 200)):
                if m.start() <= at <= m.end():
                    found.add(("email", m.start(), m.end()))
    return sorted(found)


def _mod97(s: str) -> bool:
    s = "".join(c for c in s if c.isalnum())
    return len(s) > 4 and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, a, b = span
    s = text[a:b]
    digits = "".join(c for c in s if c in "0123456789")
    groups = _GROUP.findall(s)
    sizes = [len(g) for g in groups] or [0]
    letters = sum(c.isalpha() for c in s)
    ip = [int(g) for g in groups] if kind == "ip" else []
    before, after = text[max(0, a - 1) : a], text[b : b + 1]
    side = lambda c: 0.0 if not c or c.isspace() else 1.0 if c.isdigit() else 2.0 if c.isalpha() else 3.0 if c in "\"'" else 4.0
    near = text[max(0, a - WINDOW) : a]
    head = int(digits[:4] or 0)
    changes = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:]))
    entropy = -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())
    touches = text[b : b + 2]
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(digits)), float(len(groups)), float(max(sizes)), float(min(sizes)), float(letters),
        float(bool(digits) and luhn(digits)), float(len(ip) == 4 and max(ip) <= 255), float(s[:1] == "+"), float("(" in s), float("-" in s), float("/" in s), float(" " in s), float(s.count(".")),
        float("@" in s), float("at)" in s or "at]" in s), float(" at " in s), float("dot" in s), float(len(re.split(r"[.\s)\]]", s)[-1])), side(before), side(after),
        float(bool(_HINTS[kind].search(near))), float(bool(_OTHER.search(near))), len(digits) / max(1, len(s)), float(sizes[-1]), float(sizes[0]), float(len(set(sizes)) == 1),
        float(1900 <= head <= 2099), float(head // 10 in (978, 979) or head // 100 in (15, 16, 17)), float(len(set(digits))), float(changes), entropy, float(bool(re.fullmatch(r"[0-9a-f]+", s))),
        float(kind == "identity" and letters > 0 and _mod97(s)), float(len(touches) == 2 and touches[0] in ".-/" and touches[1].isdigit()), float(a > 1 and before in ".-/" and text[a - 2].isdigit()), float(near.rstrip(" \"'")[-1:] in (":", "=") and bool(near.strip())),
    ]


N_FEATURES = len(features("a@b.c", ("email", 0, 5)))
#: The features that the text before the words written in decides: announced, announced as something else, behind a colon.
F_HINT, F_OTHER, F_COLON = 22, 23, N_FEATURES - 1

_CUES = {
    "email": ("email: ", "write to ", "contact "), "ip": ("ip ", "host ", "server "), "card": ("card ", "visa ", "credit card: "), "phone": ("phone ", "tel: ", "call "),
    "account": ("account ", "account no. ", "customer "), "identity": ("ssn ", "tax id ", "passport "), "secret": ("token = ", "api_key: ", "password=", "secret = "),
}


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _checked(rng: random.Random, n: int) -> str:
    body = _digits(rng, n - 1)
    return next(body + d for d in "0123456789" if luhn(body + d))


def _cut(s: str, *sizes: int, by: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(s[at : at + n])
        at += n
    return by.join(x for x in (*out, s[at:]) if x)


def _name(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))


def _positives(rng: random.Random) -> Iterator[tuple[str, str]]:
    """Personal data of each kind in some format."""
    user, host, top = _name(rng, rng.randint(3, 9)), _name(rng, rng.randint(4, 9)), rng.choice(("com", "org", "net", "de", "fr"))
    yield "email", rng.choice((f"{user} (at) {host}.{top}", f"{user}[at]{host}[dot]{top}", f"{user} at {host} dot {top}", f"{user}@{host} dot {top}", f"{user}(at){host}.{top}"))
    four = [str(rng.randint(1, 254)) for _ in range(4)]
    yield "ip", rng.choice(("[.]", "(.)")).join(four)
    yield "card", _cut(_checked(rng, 16), 4, 4, 4, by=rng.choice((".", "/")))
    x, y, z = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    yield "phone", rng.choice((f"({x}) {y}-{z}", f"{x}-{y}-{z}", f"{x}.{y}.{z}", f"{x} {y} {z}", f"0{x[:2]} {y}{z}", f"0{x}/{y}{z}"))
    long = _digits(rng, rng.randint(12, 18))
    long = _digits(rng, 16) if len(long) == 13 and long[:2] in ("15", "16", "17", "97") else long
    yield "account", rng.choice((long, long, _cut(long, 4, 4, 4, 4, by=" "), _cut(long, 4, 4, 4, 4, by="-")))
    country, rest = rng.choice(("DE", "FR", "GB", "ES")), _digits(rng, rng.randint(14, 20))
    check = 98 - int("".join(str(int(c, 36)) for c in rest + country) + "00") % 97
    iban = f"{country}{check:02}{rest}"
    banked = _iban(rng.choice(("GB", "NL", "IE")), _name(rng, 4).upper() + _digits(rng, rng.choice((10, 14))))
    yield "identity", rng.choice((f"{x}-{y[:2]}-{z}", iban, _cut(iban, 4, 4, 4, 4, 4, by=" "), banked, _cut(banked, 4, 4, 4, 4, 4, by=" ")))
    alphabet = rng.choice(("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789_-"))
    value = "".join(rng.choices(alphabet, k=rng.choice((20, 24, 32, 40, 48, 64)))) + str(rng.randint(0, 9)) + rng.choice("abcdef")
    yield "secret", rng.choice((value, value, _vendor_key(rng)))


def _iban(country: str, rest: str) -> str:
    check = 98 - int("".join(str(int(c, 36)) for c in rest + country) + "00") % 97
    return f"{country}{check:02}{rest}"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_BOTH = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _vendor_key(rng: random.Random) -> str:
    """A key of upper-case letters and digits, or one behind a short prefix."""
    if rng.random() < 0.5:
        return "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=4)) + "".join(rng.choices(_UPPER, k=rng.choice((12, 16, 20))))
    return f"{_name(rng, rng.randint(2, 3))}{rng.choice(('_', '-'))}{rng.choice(('', 'live_', 'test_', 'proj-'))}" + "".join(rng.choices(_BOTH, k=rng.choice((24, 32, 36)))) + str(rng.randint(0, 9))


def _password(rng: random.Random) -> str:
    """What a person might choose."""
    word = _name(rng, rng.randint(4, 8))
    return rng.choice((word + str(rng.randint(1, 9999)), word + str(rng.randint(0, 99)) + _name(rng, rng.randint(3, 6)), word.capitalize() + rng.choice("!#$@_-") + str(rng.randint(1, 999)), _name(rng, 3) + "-" + _name(rng, 4) + str(rng.randint(10, 99)) + "!"))


def _negatives(rng: random.Random) -> Iterator[tuple[str, str]]:
    """(words before, look-alike)."""
    year, month, day = rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 28)
    hexes = "".join(rng.choices("0123456789abcdef", k=40))
    yield rng.choice(("", "since ", "date ")), rng.choice((f"{year}-{month:02}-{day:02}", f"{day:02}/{month:02}/{year}", f"{day}.{month}.{year}", f"{year}{month:02}{day:02}", f"{year}-{month:02}-{day:02} {rng.randint(0, 23):02}"))
    yield rng.choice(("from ", "between ", "")), f"{rng.randint(1900, 2019)}-{year}"
    yield rng.choice(("", "total ", "order ")), rng.choice((_digits(rng, rng.randint(7, 9)), f"{rng.randint(10, 999)}.{_digits(rng, rng.randint(5, 9))}", f"{rng.randint(1, 999)}.{_digits(rng, 3)}.{_digits(rng, 3)}", f"1{rng.randint(5, 7)}{_digits(rng, rng.choice((8, 11)))}"))
    yield rng.choice(("ISBN ", "", "ean ")), rng.choice((f"978{_digits(rng, 10)}", f"978-{_digits(rng, 1)}-{_digits(rng, 4)}-{_digits(rng, 4)}-{_digits(rng, 1)}"))
    yield rng.choice(("commit ", "sha1 ", "md5 ", "checksum ")), rng.choice((hexes, hexes[:32]))
    yield rng.choice(("uuid ", "file ", "")), rng.choice((f"{hexes[:8]}-{hexes[8:12]}-{hexes[12:16]}-{hexes[16:20]}-{hexes[20:32]}", f"{_name(rng, 8)}_{_name(rng, 6)}_{rng.randint(1, 99)}", f"{_name(rng, 9)}-{year}-{_name(rng, 5)}"))
    yield rng.choice(("version ", "")), f"{rng.randint(256, 999)}[.]{rng.randint(0, 9)}[.]{rng.randint(256, 999)}[.]{rng.randint(0, 9)}"
    yield "", f"{_name(rng, 5)} at {_name(rng, 4)}.{_name(rng, 12)}"
    yield rng.choice(("total ", "")), rng.choice("0123456789") * rng.randint(8, 18)
    yield rng.choice(("pages ", "between pages ")), f"{rng.randint(100, 900)}-{rng.randint(901, 1999)}"
    yield rng.choice(("population ", "inhabitants ", "revenue ", "about ", "")), _thousands(rng, " ")
    yield rng.choice(("password: ", "token: ", "secret = ", "credentials: ")), rng.choice(("required", "optional", "missing", "see below", "unknown", "expired", "your", "disabled", _name(rng, rng.randint(6, 10))))


def _thousands(rng: random.Random, by: str) -> str:
    return by.join([str(rng.randint(1, 999)), *(_digits(rng, 3) for _ in range(rng.randint(2, 4)))])


def _other_positives(rng: random.Random) -> Iterator[tuple[str, str, str]]:
    """(words before, kind, form): what thresholds are calibrated on; other formats and words than those that are learned from."""
    user, host = f"{_name(rng, 4)}.{_name(rng, 5)}", _name(rng, rng.randint(5, 8))
    yield rng.choice(("mail me: ", "reach ", "kontakt ", "")), "email", rng.choice((f"{user}(at){host}(dot)com", f"{user} [at] {host} [dot] net", f"{user} at {host} dot co dot uk"))
    yield rng.choice(("from ", "gateway ", "")), "ip", rng.choice(("[.]", "(.)")).join(str(rng.randint(1, 254)) for _ in range(4))
    yield rng.choice(("paid with ", "mastercard ", "")), "card", _cut(_checked(rng, 16), 4, 4, 4, by=".")
    yield rng.choice(("ring ", "fax ", "mobile: ", "whatsapp ", "", "")), "phone", rng.choice((f"({_digits(rng, 3)}) {_digits(rng, 3)} {_digits(rng, 4)}", f"0{_digits(rng, 3)} {_digits(rng, 3)} {_digits(rng, 3)}", f"{_digits(rng, 3)}.{_digits(rng, 3)}.{_digits(rng, 4)}"))
    yield rng.choice(("acct: ", "konto ", "member number ", "", "", "")), "account", rng.choice((_digits(rng, 14), _digits(rng, 16), _cut(_digits(rng, 12), 4, 4, by="-"), _cut(_digits(rng, 16), 4, 4, 4, by=" ")))
    yield rng.choice(("social security ", "id ", "iban: ", "")), "identity", rng.choice((f"{_digits(rng, 3)}-{_digits(rng, 2)}-{_digits(rng, 4)}", _cut(_iban("NO", _digits(rng, 15)), 4, 4, 4, by=" "), _iban("BE", _digits(rng, 16)), _cut(_iban("RO", _name(rng, 4).upper() + _digits(rng, 16)), 4, 4, 4, 4, 4, by=" ")))
    yield rng.choice(("bearer ", "secret key ", "auth: ", "")), "secret", rng.choice((_vendor_key(rng), "".join(rng.choices(_BOTH + "_-", k=43)) + "1x"))
    yield rng.choice(("passwort: ", "pwd = ", "login password: ")), "secret", _password(rng)


def _other_negatives(rng: random.Random) -> Iterator[tuple[str, str]]:
    """(words before, look-alike), written by the same other hand."""
    year = rng.randint(1950, 2060)
    yield rng.choice(("on ", "issued ", "")), rng.choice((f"{year}.{rng.randint(1, 12):02}.{rng.randint(1, 28):02}", f"{rng.randint(1, 28):02}-{rng.randint(1, 12):02}-{year}", f"{year}-{year + 1}"))
    yield rng.choice(("pages ", "page ")), f"{rng.randint(100, 999)}-{rng.randint(1000, 1999)}"
    yield rng.choice(("budget ", "views ", "people ")), _thousands(rng, " ")
    yield rng.choice(("ISBN: ", "isbn-13 ")), f"979-{_digits(rng, 2)}-{_digits(rng, 3)}-{_digits(rng, 4)}-{_digits(rng, 1)}"
    yield rng.choice(("build ", "revision ", "sha256 ", "md5: ")), "".join(rng.choices("0123456789abcdef", k=rng.choice((32, 40, 64))))
    yield rng.choice(("see ", "img ", "")), f"{_name(rng, 6)}-{_name(rng, 5)}-{_name(rng, 7)}-{rng.randint(1, 99)}"
    yield rng.choice(("password = ", "api key: ", "secret: ")), rng.choice(("forgotten", "not set", "hidden", "changed", "invalid", _name(rng, 7)))
    yield rng.choice(("order no. ", "ticket ", "case ")), _digits(rng, rng.randint(7, 9))


def _written(text: str, place: int, end: int, form: str, rest: int = 60) -> tuple[str, int]:
    """Some context with ``form`` instead of text[place:end], and where it begins."""
    a = max(0, place - rest)
    return text[a:place] + form + text[end : end + rest], place - a


def _rewritten(text: str, span: Span, rng: random.Random) -> Iterator[tuple[str, str, float]]:
    """Other forms of a base span, with their labels."""
    kind, a, b = span
    s, digits = text[a:b], [c for c in text[a:b] if c.isdigit()]
    if kind == "email":
        user, _, host = s.rpartition("@")
        yield kind, f"{user}[at]{host.replace('.', '[dot]')}", 1.0
        yield kind, f"{user} at {host.replace('.', ' dot ')}", 1.0
    elif kind == "phone" and len(digits) >= 10:
        x, y, z = "".join(digits[-10:-7]), "".join(digits[-7:-4]), "".join(digits[-4:])
        yield kind, f"({x}) {y}-{z}", 1.0
    elif kind == "card":
        digits[-1] = str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        yield kind, "".join(digits), 0.0
    elif kind == "ip":
        yield kind, s.replace(".", "[.]"), 1.0


def _lower(text: str) -> str:
    """``text`` in lower case, of the same length, with the letters that patterns take for s, k and i whatever the case."""
    return text.replace("\u017f", "s").replace("\u212a", "k").replace("\u0130", "i").replace("\u0131", "i").lower()


def contexts(texts: list[str]) -> np.ndarray:
    """How many places of ``texts`` have each context, by kind, distances from the nearest word that announces the kind and something else (0: none), and colon.

    A text without words has one place.
    """
    counts = np.zeros((len(KINDS), WINDOW + 1, WINDOW + 1, 2), np.int64)
    counts[:, 0, 0, 0] += sum(not t or t.isspace() for t in texts)
    whole = ("\n" * (WINDOW + 1)).join(texts)
    for base in range(0, len(whole), PIECE):
        a = max(0, base - 2 * WINDOW)
        piece = whole[a : base + PIECE]
        places = np.fromiter((m.start() for m in _WORD.finditer(piece, base - a)), np.int64)
        if base and len(places) and places[0] == base - a and not piece[base - a - 1].isspace():
            places = places[1:]  # its word began in the piece before
        low = _lower(piece)

        def away(pattern: re.Pattern, piece=piece, low=low, places=places) -> np.ndarray:
            found = []
            for begin in _BEGIN[pattern]:
                at = low.find(begin)
                while at >= 0:
                    m = pattern.match(piece, at)
                    if m:
                        found.append((m.end(), at))
                    at = low.find(begin, at + 1)
            if not found:
                return np.zeros(len(places), np.int64)
            ends, starts = np.array(sorted(found), np.int64).T
            starts = np.maximum.accumulate(starts)
            k = np.searchsorted(ends, places, "right")
            d = np.where(k > 0, places - starts[k - 1], 0)
            return np.where(d <= WINDOW, d, 0)

        behind = [p for m in _COLON.finditer(piece) for p in range(m.start() + 1, min(m.end(), m.start() + WINDOW) + 1)]
        rest = away(_OTHER) * 2 + np.isin(places, np.array(behind, np.int64))
        for k, kind in enumerate(KINDS):
            at = away(_HINTS[kind]) * (2 * WINDOW + 2) + rest
            counts[k] += np.bincount(at, minlength=counts[k].size).reshape(counts[k].shape)
    return counts


def rewritten_of(text: str, draw: int) -> list[tuple[float, list[float]]]:
    """Labelled rewritings of all base spans of a document, in place."""
    rng, out = random.Random(draw), []
    for span in base_spans(text):
        for kind, form, label in _rewritten(text, span, rng):
            made, a = _written(text, span[1], span[2], form)
            out += [(label, features(made, c)) for c in candidates(made) if c == (kind, a, a + len(form))]
    return out


SEEN = "held boolean, kind int, hint int, other int, colon int, label double, x array<double>, n long"
_SEEN = pa.schema([("held", pa.bool_()), ("kind", pa.int32()), ("hint", pa.int32()), ("other", pa.int32()), ("colon", pa.int32()), ("label", pa.float64()), ("x", pa.list_(pa.float64())), ("n", pa.int64())])


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the documents give: numbers of their places by context, of themselves (kind -1), and rewritings of base spans (those with ``x``)."""
    for batch in batches:
        draws, texts = batch.column("draw").to_pylist(), batch.column("text").to_pylist()
        out = []
        for held in (False, True):
            own = [(d, t) for d, t in zip(draws, texts, strict=True) if (d % 4 == 0) == held]
            counts = contexts([t for _, t in own])
            out += [{"held": held, "kind": k, "hint": h, "other": o, "colon": c, "n": int(counts[k, h, o, c])} for k, h, o, c in np.argwhere(counts).tolist()]
            out.append({"held": held, "kind": -1, "n": len(own)})
            if not held:
                out += [{"held": held, "label": label, "x": x, "n": 1} for d, t in own for label, x in rewritten_of(t, d)]
        yield pa.RecordBatch.from_pylist(out, _SEEN)


def calibration_of(draw: int) -> Iterator[tuple[str, float, list[float]]]:
    """Labelled examples of the other generator, each with the words before it."""
    rng = random.Random(draw)
    for cue, kind, form in _other_positives(rng):
        made, a = f"{cue}{form} ", len(cue)
        for c in candidates(made):
            if c == (kind, a, a + len(form)):
                yield cue, 1.0, features(made, c)
    for cue, form in _other_negatives(rng):
        made, a = f"{cue}{form} ", len(cue)
        for c in candidates(made):
            if a <= c[1] and c[2] <= a + len(form):
                yield made[: c[1]], 0.0, features(made, c)


def examples_of(draw: int) -> Iterator[tuple[str, float, list[float]]]:
    """Labelled examples, each with the words before it."""
    rng = random.Random(draw)
    for kind, form in _positives(rng):
        weak = kind == "secret" and rng.random() < 0.9 or rng.random() < 0.5
        quote = rng.choice(('"', "'", "")) if kind == "secret" else ""
        cue = (rng.choice(_CUES[kind]) if weak else "") + quote
        made, a = f"{cue}{form}{quote} ", len(cue)
        for c in candidates(made):
            if c[1:] == (a, a + len(form)):
                if c[0] == kind:
                    yield cue, 1.0, features(made, c)
                elif kind == "account" and c[0] == "card" and not luhn("".join(_GROUP.findall(form))):
                    yield cue, 0.0, features(made, c)
    for cue, form in ((rng.choice(("password: ", "password=", "passwd: ", "passphrase: ", "secret: ")), _password(rng)), (rng.choice(("key ", "keys: ", "")), _vendor_key(rng))):
        made, a = f"{cue}{form} ", len(cue)
        for c in candidates(made):
            if c == ("secret", a, a + len(form)):
                yield cue, 1.0, features(made, c)
    for cue, form in _negatives(rng):
        made, a = f"{cue}{form} ", len(cue)
        for c in candidates(made):
            if a <= c[1] and c[2] <= a + len(form):
                yield made[: c[1]], 0.0, features(made, c)


_MADE = pa.schema([("held", pa.bool_()), ("kind", pa.int32()), ("room", pa.int32()), ("bare", pa.bool_()), ("label", pa.float64()), ("x", pa.list_(pa.float64()))])


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples with ``room``, the characters of the text that count before them, and whether nothing but quotes is written before."""
    for batch in batches:
        out = []
        for draw in batch.column("id").to_pylist():
            held = draw % 4 == 0
            for before, label, x in (calibration_of if held else examples_of)(draw):
                out.append({"held": held, "kind": int(x[0]), "room": max(0, WINDOW - len(before)), "bare": not before.strip(" \"'"), "label": label, "x": x})
        yield pa.RecordBatch.from_pylist(out, _MADE)


class Trees:
    """A fitted ensemble as arrays; ``score`` gives probabilities."""

    def __init__(self, model):
        self.weights = list(model.treeWeights)
        self.nodes = []
        for tree in model.trees:
            feature, cut, left, right, value = [], [], [], [], []

            def walk(node, table=(feature, cut, left, right, value)) -> int:
                me = len(table[0])
                for column in table:
                    column.append(-1)
                table[4][me] = node.prediction()
                if node.subtreeDepth() > 0:
                    table[0][me], table[1][me] = node.split().featureIndex(), node.split().threshold()
                    table[2][me] = walk(node.leftChild(), table)
                    table[3][me] = walk(node.rightChild(), table)
                return me

            walk(tree._java_obj.rootNode())
            self.nodes.append(tuple(np.array(x, float if i in (1, 4) else np.int64) for i, x in enumerate((feature, cut, left, right, value))))
        self.thresholds = np.ones(len(KINDS))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for weight, (feature, cut, left, right, value) in zip(self.weights, self.nodes, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                to = np.where(x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at], left[at], right[at])
                at = np.where(inner, to, at)
            total += weight * value[at]
        return 1 / (1 + np.exp(-2 * total))


def in_context(seen: DataFrame) -> DataFrame:
    """The examples in each context of all places: held, label, x and ``n``, the number of those places."""
    spark = seen.sparkSession
    within = lambda c: ((F.col(c) > 0) & (F.col(c) <= F.col("room"))).cast("int").alias(c)
    counted = seen.filter("kind >= 0").groupBy("held", "kind", "hint", "other", "colon").agg(F.sum("n").alias("n"))
    rooms = spark.range(WINDOW + 1).select(F.col("id").cast("int").alias("room"))
    counted = counted.crossJoin(F.broadcast(rooms)).groupBy("held", "kind", "room", within("hint"), within("other"), "colon").agg(F.sum("n").alias("n"))
    made = spark.range(0, DRAWS, 1, FIT_TASKS).mapInArrow(_made, "held boolean, kind int, room int, bare boolean, label double, x array<double>")
    both = made.join(F.broadcast(counted), ["held", "kind", "room"])
    put = lambda v, i: F.when(i == F_HINT, F.greatest(v, "hint")).when(i == F_OTHER, F.greatest(v, "other")).when((i == F_COLON) & F.col("bare"), F.greatest(v, "colon")).otherwise(v)
    return both.select("held", "label", F.transform("x", put).alias("x"), "n").groupBy("held", "label", "x").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, precision: float = PRECISION) -> Trees | None:
    """Trees with calibrated thresholds from all of ``docs``; None if there is no text to learn from."""
    # Only the driver needs Spark ML; tasks that score need not load it.
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    texts = docs.filter(F.col("text").isNotNull()).select("text", draw.alias("draw"))
    seen = stash(texts.mapInArrow(_seen, SEEN), "seen")
    every = {(r.held, r.kind): r.n for r in seen.filter("kind <= 0").groupBy("held", "kind").agg(F.sum("n").alias("n")).collect()}
    if not every.get((False, -1)):
        return None
    # Of the draws three in four are learned from; together the places of a document weigh PLACES.
    weight = {h: PLACES * every[h, -1] / every[h, 0] / (DRAWS * (0.25 if h else 0.75)) for h in (False, True) if every.get((h, -1))}
    made = in_context(seen).withColumn("weight", F.col("n") * F.when(F.col("held"), weight.get(True, 0.0)).otherwise(weight[False]))
    spans = seen.filter("x is not null").groupBy("held", "label", "x").agg(F.sum("n").alias("n"))
    made = stash(made.unionByName(spans.withColumn("weight", F.col("n").cast("double"))), "examples")
    fit, kept_out = made.filter("not held"), made.filter("held")
    # The same rows in the same order in a number of tasks that follows from them make the same trees on every cluster.
    tasks = max(FIT_TASKS, -(-fit.count() // FIT_ROWS))
    vector = array_to_vector("x").alias("features")
    table = fit.repartition(tasks, "x").sortWithinPartitions("label", "x", "weight").select("label", "weight", vector)
    # Of the examples (not of the documents) Spark itself draws 10,000 where it looks for the 31 cuts that a feature may have; each split counts all.
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, maxMemoryInMB=128, weightCol="weight").fit(table)
    model = Trees(fitted)
    # Held-out scores of each kind by steps of 1/1000: at most 1,001 rows a kind, however many places.
    scored = fitted.transform(kept_out.select("label", "n", F.col("x")[0].cast("int").alias("kind"), vector)).select("kind", "label", "n", F.floor(vector_to_array("probability")[1] * 1000).alias("p"))
    steps = scored.groupBy("kind", "p").agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("n")).orderBy("kind", F.desc("p")).collect()
    for k in range(len(KINDS)):
        model.thresholds[k] = calibrated([(r.p / 1000, r.right, r.n) for r in steps if r.kind == k], precision)
    return model


def calibrated(steps: list[tuple[float, float, int]], precision: float = PRECISION, recall: float = RECALL) -> float:
    """The threshold of one kind, from (score, examples, candidates) by falling score; over 1 for a kind without examples.

    The lowest score that keeps ``precision`` is taken, but not under what ``recall`` of the examples reach; then the middle between it and the best
    look-alike below, as scores in between were not met.
    """
    right = n = 0
    every, keeps, enough = sum(r for _, r, _ in steps), 1.001, None
    for score, r, m in steps:
        right, n = right + r, n + m
        if right and right >= precision * n:
            keeps = score
        if enough is None and right and right >= recall * every:
            enough = score
    cut = keeps if enough is None else max(keeps, enough)
    return cut if cut > 1 else (cut + max((score for score, r, m in steps if score < cut and m > r), default=0.0)) / 2


def _free(spans: list[Span], held: list[Span]) -> list[Span]:
    """Those of ``spans`` that overlap none of ``held``."""
    if not held:
        return spans
    starts, ends = [], []
    for _, a, b in sorted(held, key=lambda s: s[1:]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for s in spans:
        k = bisect_left(starts, s[2])  # merged spans before k begin before s ends
        if not k or ends[k - 1] <= s[1]:
            out.append(s)
    return out


def best_apart(scored: list[tuple[float, Span]]) -> list[tuple[float, Span]]:
    """The best scored spans of which no two overlap, taken greedily; of equal scores the first, the shorter, the first by kind."""
    out: list[tuple[float, Span]] = []
    starts: list[int] = []
    ends: list[int] = []
    for score, span in sorted(scored, key=lambda x: (-x[0], x[1][1], x[1][2], KINDS.index(x[1][0]))):
        k = bisect_left(starts, span[2])
        if not k or ends[k - 1] <= span[1]:
            starts.insert(k, span[1])
            ends.insert(k, span[2])
            out.append((score, span))
    return out


def select(texts: list[str], model: Trees | None) -> list[list[dict]]:
    """The spans of each text, by kind and start."""
    base = [base_spans(t) for t in texts]
    found = [[{"kind": k, "start": a, "end": b, "base": True, "score": 1.0} for k, a, b in spans] for spans in base]
    if model is not None:
        more = [(i, c) for i, t in enumerate(texts) for c in _free(candidates(t), base[i])]
        scored: dict[int, list[tuple[float, Span]]] = {}
        for at in range(0, len(more), 4096):
            part = more[at : at + 4096]
            for (i, c), score in zip(part, model.score(np.array([features(texts[i], c) for i, c in part])).tolist(), strict=True):
                if score >= model.thresholds[KINDS.index(c[0])]:
                    scored.setdefault(i, []).append((score, c))
        for i, spans in scored.items():
            found[i] += [{"kind": c[0], "start": c[1], "end": c[2], "base": False, "score": score} for score, c in best_apart(spans)]
    return [sorted(spans, key=lambda s: (KINDS.index(s["kind"]), s["start"])) for spans in found]


def find_pii(docs: DataFrame, model: Trees | None) -> DataFrame:
    """``docs`` with ``pii``: the spans, by kind and start."""
    docs = docs.drop("pii")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array(select([t or "" for t in batch.column("text").to_pylist()], sent.value), _ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], [*batch.schema.names, "pii"])

    return docs.mapInArrow(find, T.StructType([*docs.schema.fields, T.StructField("pii", SPANS)]))


def redact(docs: DataFrame, model: Trees | None) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; overlapping spans become one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("pii").to_pylist(), strict=True):
                if spans:
                    parts, at = [], 0
                    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= at:
                            parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
                        at = max(at, s["end"])
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(texts, pa.string())], ["own", "text"])

    packed = pack(docs, "text")
    return unpack(find_pii(packed, model).mapInArrow(cut, packed.schema), docs.columns, "text")


def digest(found: DataFrame) -> DataFrame:
    """The report of each document: counts and hash of base spans, all spans as text."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans in batch.column("pii").to_pylist():
                base = [s for s in spans if s["base"]]
                said = lambda x: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in x)
                rows.append({f"n_{k}": sum(s["kind"] == k for s in base) for k in BASE_KINDS} | {"base_sha256": hashlib.sha256(said(base).encode()).hexdigest(), "spans": said(spans), "n_added": len(spans) - len(base), "n_spans": len(spans)})
            names = [f"n_{k}" for k in BASE_KINDS]
            kinds = [*((n, pa.int64()) for n in names), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("n_spans", pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[n] for r in rows], k) for n, k in kinds)], ["doc_id", *(n for n, _ in kinds)])

    return found.select("doc_id", "pii").mapInArrow(report, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string, n_added long, n_spans long")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return digest(find_pii(docs, train(docs)))
