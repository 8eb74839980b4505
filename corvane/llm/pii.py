"""Format-preserving Feistel pseudonyms for personal numbers, dates and addresses.

A value that validates (card numbers by Luhn and prefix, US social security and phone numbers by their ranges, IPv4 addresses,
IBANs by their check digits, calendar dates, e-mail addresses) is taken to an integer in the domain of its format,
permuted there by a keyed Feistel network with cycle walking, and written back in the same format with valid check digits.
Equal values therefore get equal pseudonyms in every document, however they are punctuated, and different values
different ones. The key is a parameter; with it `reveal` inverts every pseudonym.

A card number or IBAN may be followed by groups that are not its own (a security code, an expiry date, a word in
capitals): the longest reading is tried first, then the same without its last groups, then what starts later. Dates
are numeric (parts of one or two digits, a time of day may follow) or with an English month name. A pseudonym must be
read as its value was, so the permutation walks on where an earlier reading would validate in the pseudonym's place or
where a date would have other digits or an ambiguous name (May); only there the pseudonym depends on how the value is written.

Only values that validate are replaced; other text stays as it is, byte for byte. A null text stays null; an empty one
is empty. Values are found whole (not inside longer runs of letters or digits). Repeated rows and ties get equal
results. No rows: no rows. A very long text is scanned whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.common import blocks

ROUNDS = 8
KINDS = ("card", "ssn", "phone", "ipv4", "iban", "date", "email")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_ALNUM = _LETTERS + "0123456789"


def _round(key: bytes, kind: str, size: int, i: int, half: int) -> int:
    raw = hashlib.blake2b(f"{kind}/{size}/{i}/{half}".encode(), key=key, digest_size=16).digest()
    return int.from_bytes(raw, "big")


def permute(x: int, size: int, kind: str, key: bytes, back: bool = False) -> int:
    """The image of x under a keyed permutation of 0..size-1 (or its inverse)."""
    if size < 2:
        return x
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    while True:  # cycle walking: the network permutes 0..a*b-1
        left, right = divmod(x, b)
        steps = range(ROUNDS)
        for i in reversed(steps) if back else steps:
            sign = -1 if back else 1
            if i % 2 == 0:
                left = (left + sign * _round(key, kind, size, i, right)) % a
            else:
                right = (right + sign * _round(key, kind, size, i, left)) % b
        x = left * b + right
        if x < size:
            return x


def luhn(digits: str) -> int:
    """The check digit that follows `digits`."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


Permutation = Callable[[int, int, str], int]


def _card(m: re.Match | list[str], p: Permutation) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or len(set(digits)) == 1:
        return None
    if luhn(digits[:-1]) != int(digits[-1]):
        return None
    n = len(digits) - 2  # the network's first digit stays
    body = digits[0] + str(p(int(digits[1:-1]), 10**n, f"card{n}")).zfill(n)
    return _refill(m[0], body + str(luhn(body)))


def _ssn(m: re.Match, p: Permutation) -> str | None:
    area, group, serial = int(m["a"]), int(m["g"]), int(m["s"])
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return None
    areas = area - 1 - (area > 666)
    y = p((areas * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    y, serial = divmod(y, 9999)
    areas, group = divmod(y, 99)
    area = areas + 1 + (areas + 1 >= 666)
    return _refill(m[0], f"{area:03d}{group + 1:02d}{serial + 1:04d}")


def _phone(m: re.Match, p: Permutation) -> str | None:
    digits = re.sub(r"\D", "", m["body"])
    area, office, line = int(digits[:3]), int(digits[3:6]), int(digits[6:])
    if area < 200 or office < 200:
        return None
    y = p(((area - 200) * 800 + office - 200) * 10_000 + line, 800 * 800 * 10_000, "phone")
    y, line = divmod(y, 10_000)
    area, office = divmod(y, 800)
    return (m["cc"] or "") + _refill(m["body"], f"{area + 200:03d}{office + 200:03d}{line:04d}")


def _ipv4(m: re.Match, p: Permutation) -> str | None:
    parts = m[0].split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    y = p(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ipv4")
    return ".".join(map(str, y.to_bytes(4, "big")))


def _iban(m: re.Match | list[str], p: Permutation) -> str | None:
    raw = m[0].replace(" ", "").upper()
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(raw) <= 34 or not 2 <= int(raw[2:4]) <= 98 or number(raw[4:] + raw[:4]) % 97 != 1:
        return None
    body, size, value = raw[4:], 1, 0
    for c in body:  # mixed radix: a digit stays a digit and a letter a letter
        value, size = (value * 10 + int(c), size * 10) if c.isdigit() else (value * 26 + ord(c) - 65, size * 26)
    shape = re.sub(r"\d", "0", re.sub("[A-Z]", "A", body))
    value, out = p(value, size, "iban" + raw[:2] + shape), []
    for c in reversed(body):
        value, x = divmod(value, 10 if c.isdigit() else 26)
        out.append(str(x) if c.isdigit() else chr(65 + x))
    body = "".join(reversed(out))
    it = iter(raw[:2] + f"{98 - number(body + raw[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(it) for c in m[0])


_FIRST, _DAYS = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal() - date(1900, 1, 1).toordinal() + 1


@lru_cache(maxsize=1)
def _date_classes() -> tuple[dict[int, tuple[int, int]], list[list[int]]]:
    """Each date's class and place in it, and the classes' dates.

    A date is permuted within its class, which depends on the date alone: so it has one pseudonym however it is written, and the
    pseudonym can be written likewise and read back. Days over 12 can't be taken for months; one-digit days and months keep
    their width; May has no short name of its own, and only September has a second one.
    """
    place, classes, number = {}, [], {}
    for at in range(_FIRST, _FIRST + _DAYS):
        d = date.fromordinal(at)
        kind = (d.day >= 10) + (d.day > 12), d.month if d.month in (5, 9) else 10 * (d.month >= 10)
        if kind not in number:
            number[kind] = len(classes)
            classes.append([])
        place[at] = number[kind], len(classes[number[kind]])
        classes[number[kind]].append(at)
    return place, classes


_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = {name: i for i, full in enumerate(_MONTHS, 1) for name in (full, full[:3])} | {"sept": 9}


def _suffix(day: int) -> str:
    return {1: "st", 2: "nd", 3: "rd"}.get(day % 10 if day not in (11, 12, 13) else 0, "th")


def _like(text: str, shape: str) -> str:
    return text.upper() if shape.isupper() else text.title() if shape.istitle() else text


def _date(m: re.Match, p: Permutation) -> str | None:
    n = next(i for i in "1234" if m["y" + i])
    year, month, day = "y" + n, "m" + n, "d" + n
    slashed = n == "2" and m["s2"] == "/"
    if month_first := slashed and int(m[day]) <= 12:  # 12/31/1999; with other marks the day stands first
        month, day = day, month
    name = m[month].lower() if n in "34" else ""
    if name and not (m[month].isupper() or m[month].islower() or m[month].istitle()):
        return None
    try:
        old = date(int(m[year]), _MONTH[name] if name else int(m[month]), int(m[day]))
    except ValueError:
        return None
    ordinal = "o" + n if name and m["o" + n] else ""
    if not 0 <= old.toordinal() - _FIRST < _DAYS or ordinal and m[ordinal].lower() != _suffix(old.day):
        return None
    kind, at = _date_classes()[0][old.toordinal()]
    days = _date_classes()[1][kind]
    new = date.fromordinal(days[p(at, len(days), f"date{kind}")])
    full = _MONTHS[new.month - 1]
    called = name if name in ("may", "sept") else full if name in _MONTHS else full[:3]
    parts = {year: f"{new.year:04d}", month: _like(called, m[month]) if name else str(new.month).zfill(len(m[month])), day: str(new.day).zfill(len(m[day]))}
    if ordinal:
        parts[ordinal] = _like(_suffix(new.day), m[ordinal] if m[ordinal].isupper() else "")
    out, end = [], m.start()
    for part in sorted(parts, key=m.start):
        out += [m.string[end : m.start(part)], parts[part]]
        end = m.end(part)
    return "".join([*out, m.string[end : m.end()]])


def _email(m: re.Match, p: Permutation) -> str | None:
    local = m["local"]
    size, value, shape = 1, 0, []
    for c in local.lower():
        base = 26 if c in _LETTERS else 10 if c.isdigit() else 0
        shape.append("a" if base == 26 else "0" if base else c)
        if base:
            value, size = value * base + (ord(c) - 97 if base == 26 else int(c)), size * base
    if size < 2:
        return None
    value, out = p(value, size, "email" + "".join(shape) + "@" + m["domain"].lower()), []
    for c in reversed(shape):
        if c in "a0":
            value, x = divmod(value, 26 if c == "a" else 10)
            c = chr(97 + x) if c == "a" else str(x)
        out.append(c)
    return "".join(reversed(out)) + "@" + m["domain"]


_NAME, _ORDINAL = f"(?i:{'|'.join(sorted(_MONTH, key=len, reverse=True))})", "(?i:st|nd|rd|th)"
_PATTERNS: dict[str, tuple[str, Callable[[re.Match, Permutation], str | None]]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63})@(?P<domain>[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24})(?![A-Za-z0-9])", _email),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    "ipv4": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _ipv4),
    "date": (
        r"(?<![\w./-])(?:(?P<y1>(?:19|20)\d\d)(?P<s1>[-/.])(?P<m1>\d\d?)(?P=s1)(?P<d1>\d\d?)|(?P<d2>\d\d?)(?P<s2>[-/.])(?P<m2>\d\d?)(?P=s2)(?P<y2>(?:19|20)\d\d)"
        rf"|(?P<d3>\d\d?)(?P<o3>{_ORDINAL})?(?:\s|-|\.\s|\sof\s)(?P<m3>{_NAME})(?:\.?\s|-|,\s)(?P<y3>(?:19|20)\d\d)|(?P<m4>{_NAME})(?:\.?\s|-)(?P<d4>\d\d?)(?P<o4>{_ORDINAL})?(?:,?\s|,|-)(?P<y4>(?:19|20)\d\d))"
        r"(?:(?=[Tt]\d\d)|(?![\w/-]|\.\d))",
        _date,
    ),
    "ssn": (r"(?<![\w-])(?P<a>\d{3})-(?P<g>\d\d)-(?P<s>\d{4})(?![\w-])", _ssn),
    "phone": (r"(?<![\w+.-])(?P<cc>\+?1[ .-]?)?(?P<body>\(\d{3}\) ?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-]|\.\d)", _phone),
    "card": (r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3}(?!/\d))?|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]|\.\d)", _card),
}
_COMPILED = {k: (re.compile(p, re.ASCII), f) for k, (p, f) in _PATTERNS.items()}
_GAP = re.compile("[ -]")
_MAYBE = re.compile(r"[0-9@]")
#: Kinds whose last groups may not be their own. Their pseudonyms have the length of the value.
_GROUPED = ("iban", "card")


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with pseudonyms (or, with `back`, the values they stand for), and what was replaced: kind, value, pseudonym."""
    done: list[tuple[str, str, str]] = []
    if not _MAYBE.search(text):
        return text, done
    taken: list[tuple[int, int, str]] = []
    failed: list[tuple[Callable, int, int]] = []  # readings that don't validate, and mustn't in the result
    p = lambda x, size, what: permute(x, size, what, key, back)
    for kind, (pattern, f) in _COMPILED.items():
        if kind == "email" and "@" not in text:
            continue
        m = pattern.search(text)
        while m:
            start, new = m.start(), None
            for end in (m.end(), *(start + x.start() for x in reversed([*_GAP.finditer(m[0])]) if kind in _GROUPED)):
                if any(a < end and start < b for a, b, _ in taken):
                    continue
                new = f(m if end == m.end() else [text[start:end]], p)
                if new is not None:
                    break
                if kind in _GROUPED:
                    failed.append((f, start, end))
            if new is None:
                m = pattern.search(text, start + 1)
                continue
            if kind in _GROUPED and (near := [x for x in failed if x[1] < end and start < x[2]]):
                while any(g([(text[min(a, start) : start] + new + text[end : max(b, end)])[max(0, a - start) :][: b - a]], p) is not None for g, a, b in near):
                    new = f([new], p)
            taken.append((start, end, new))
            done.append((kind, text[start:end], new))
            m = pattern.search(text, end)
    out, at = [], 0
    for a, b, new in sorted(taken):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), done


@lru_cache(maxsize=8)
def _key(secret: str) -> bytes:
    return hashlib.blake2b(secret.encode(), digest_size=32, person=b"pseudonym-key").digest()


def reveal(text: str, secret: str) -> str:
    """The text before `pseudonymised`."""
    return pseudonymise(text, _key(secret), back=True)[0]


def pseudonymised(docs: DataFrame, secret: str) -> DataFrame:
    """A row per document: doc_id, text with pseudonyms, n_found, and a count for each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = _key(secret)
        for part in blocks(batches):
            texts, total, counts = [], [], {k: [] for k in KINDS}
            for text in part.column("text").to_pylist():
                new, done = pseudonymise(text, key) if text else (text, [])
                texts.append(new)
                total.append(len(done))
                kinds = [d[0] for d in done]
                for k in KINDS:
                    counts[k].append(kinds.count(k))
            columns = [part.column("doc_id"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), *(pa.array(counts[k], pa.int64()) for k in KINDS)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_found", *(f"n_{k}" for k in KINDS)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, n_found long, " + ", ".join(f"n_{k} long" for k in KINDS))
