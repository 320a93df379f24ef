"""Format-preserving pseudonyms for numbers, addresses and dates.

Values are found by pattern, validated (check digits, octets, calendar), and mapped by
a keyed Feistel permutation of the values that have the same format. Equal values get equal
pseudonyms in every document, different values different ones, punctuation stays, and
the result is valid again: card numbers keep a right check digit, dates are days. Phone numbers have
no check digit; they are told by their form alone.
Where a run of digits or an IBAN with its neighbours isn't valid, its parts between separators are tried,
the longest first. A part may be valid by chance, and a pseudonym with its neighbours too, so that
only the values of the spans found, not all texts, are sure to come back by ``back``.

Edge cases: a null text stays null and has no findings; an empty text stays empty;
texts of any length are searched whole; repeated rows are masked alike; an empty table
gives an empty table; further columns are ignored or, by ``mask_documents``, kept.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_rows

ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")
_EPOCH, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # 1900-01-01 to 2099-12-31

_NUMBERS = re.compile(
    r"(?P<date>(?<![\d.\-/])(?:(?:19|20)\d\d([-/.])(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.])(?:0[1-9]|1[0-2])\3(?:19|20)\d\d|(?:0[1-9]|1[0-2])([-/.])(?:1[3-9]|2\d|3[01])\4(?:19|20)\d\d)(?![\d\-/]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d))"
    r"|(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))"
    r"|(?P<phone>(?<![\w+])(?:\+?\d{1,3}[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\d)|(?<![\w+\-.])\+\d{1,3}[ .\-]\d{3}[ .\-]\d{3}[ .\-]\d{4}(?!\d)|(?<![\w+\-.])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<card>(?:(?<![\w\-])|(?<=\d-))\d(?:[ \-]?\d){12,18}(?!\w|-(?!\d)))"
)
_MAIL = re.compile(r"(?<![\w.+\-])[A-Za-z0-9_+\-]+(?:\.[A-Za-z0-9_+\-]+)*@(?=[A-Za-z0-9\-]+\.)")
_DIGIT = re.compile(r"\d")
_SEPARATOR = re.compile(r"[^0-9A-Za-z]")
#: Characters of an IBAN by country, from the registry; for other countries all lengths from 15 to 34 are tried.
_IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 "
    "JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size-1: a balanced Feistel network, walked until the result is below ``size``."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    while True:
        left, right = value >> half, value & mask
        for k in order:
            if back:
                left, right = right ^ _round(left, k, key, tweak, width, mask), left
            else:
                left, right = right, left ^ _round(right, k, key, tweak, width, mask)
        value = left << half | right
        if value < size:
            return value


def _round(x: int, k: int, key: bytes, tweak: str, width: int, mask: int) -> int:
    h = hashlib.blake2b(x.to_bytes(width, "big"), key=key, person=b"feistel%d" % k, salt=hashlib.blake2b(tweak.encode(), digest_size=16).digest(), digest_size=width)
    return int.from_bytes(h.digest(), "big") & mask


def luhn_digit(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    total = 0
    for at, c in enumerate(reversed(digits)):
        x = int(c) * (2 if at % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    fresh = iter(digits)
    return "".join(next(fresh) if c.isdigit() else c for c in shape)


def _only_digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def _card(value: str, key: bytes, back: bool) -> str | None:
    d = _only_digits(value)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    n = len(d) - 1
    body = int(d[:-1])
    while True:  # numbers of one repeated digit are no cards, so neither are their images
        body = permute(body, 10**n, key, f"card{n}", back)
        text = f"{body:0{n}d}"
        text += str(luhn_digit(text))
        if len(set(text)) > 1:
            return _refill(value, text)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(value: str, key: bytes, back: bool) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body, number, size = plain[4:], 0, 1
    shape = "".join("d" if c.isdigit() else "a" for c in body)
    for c in body:
        base = 10 if c.isdigit() else 26
        number, size = number * base + (int(c) if base == 10 else ord(c) - 65), size * base
    number, out = permute(number, size, key, f"iban{plain[:2]}{shape}", back), []
    for c in reversed(shape):
        number, x = divmod(number, 10 if c == "d" else 26)
        out.append(str(x) if c == "d" else chr(65 + x))
    fresh = "".join(reversed(out))
    plain = f"{plain[:2]}{98 - _mod97(fresh + plain[:2] + '00'):02d}{fresh}"
    letters = iter(plain)
    return "".join(c if c == " " else next(letters) for c in value)


def _ssn(value: str, key: bytes, back: bool) -> str | None:
    area, group, serial = (int(x) for x in value.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    rank = area - 1 - (area > 666)  # 898 areas, 99 groups, 9999 serials
    x = permute((rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn", back)
    x, serial = divmod(x, 9999)
    rank, group = divmod(x, 99)
    return f"{rank + 1 + (rank >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(value: str, key: bytes, back: bool) -> str | None:
    d = _only_digits(value)
    code, rest = d[:-10], d[-10:]
    return _refill(value, code + f"{permute(int(rest), 10**10, key, f'phone{code}', back):010d}")


def _ip(value: str, key: bytes, back: bool) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(value: str, key: bytes, back: bool) -> str | None:
    first = len(value.split(next(c for c in value if not c.isdigit()))[0]) == 4
    d = _only_digits(value)
    shape = "%Y%m%d" if first else "%m%d%Y" if int(d[2:4]) > 12 else "%d%m%Y"
    try:
        day = datetime.datetime.strptime(d, shape).date()
    except ValueError:
        return None
    while True:  # a month-first date is told by its day beyond 12, so its images have one too
        day = datetime.date.fromordinal(_EPOCH + permute(day.toordinal() - _EPOCH, _DAYS, key, "date", back))
        if shape != "%m%d%Y" or day.day > 12:
            return _refill(value, day.strftime(shape))


def _email(value: str, key: bytes, back: bool) -> str | None:
    """The part before the @, letter for letter and digit for digit."""
    number, size = 0, 1
    shape = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in value)
    for c, s in zip(value, shape, strict=True):
        if s in "9Aa":
            base = 10 if s == "9" else 26
            number, size = number * base + (int(c) if s == "9" else ord(c) - ord(s)), size * base
    number, out = permute(number, size, key, f"email{shape}", back), []
    for s in reversed(shape):
        if s in "9Aa":
            number, x = divmod(number, 10 if s == "9" else 26)
            out.append(str(x) if s == "9" else chr(ord(s) + x))
        else:
            out.append(s)
    return "".join(reversed(out))


_MAKE: dict[str, Callable[[str, bytes, bool], str | None]] = {"card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date, "email": _email}


@functools.lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value of ``kind``, or None if the value isn't valid. ``back``: the value of a pseudonym."""
    return _MAKE[kind](value, key, back)


def _parts(kind: str, value: str) -> list[tuple[int, int]]:
    """The ranges of a candidate that may be a value, in the order to try: all of it, then what begins and ends at separators."""
    whole = [(0, len(value))]
    if kind not in ("card", "iban"):
        return whole
    cuts = [m.start() for m in _SEPARATOR.finditer(value)]
    if kind == "iban":
        size = _IBAN_LENGTHS.get(value[:2])
        parts = [(0, b) for b in [len(value), *reversed(cuts)]]
        right = [p for p in parts if p[1] - value.count(" ", 0, p[1]) == size]
        return right + [p for p in (whole if size else parts) if p not in right]
    parts = [(a, b) for a in [0, *(c + 1 for c in cuts)] for b in [*cuts, len(value)] if a < b and 13 <= len(_only_digits(value[a:b])) <= 19]
    return sorted(parts, key=lambda p: (p[0] - p[1], p))


def _numbers(text: str, key: bytes, back: bool, taken: set[int]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the valid numbers that don't touch the places ``taken``, which grow by theirs."""
    at = 0
    while m := _NUMBERS.search(text, at):
        kind, value = m.lastgroup, m.group()
        cut = _SEPARATOR.search(value)
        at = m.start() + cut.end() if cut else m.end()  # where nothing is valid, a number may begin behind the first separator
        for a, b in _parts(kind, value):
            a, b = m.start() + a, m.start() + b
            fresh = pseudonym(kind, text[a:b], key, back) if taken.isdisjoint(range(a, b)) else None
            if fresh is not None:
                yield a, b, kind, fresh
                taken.update(range(a, b))
                at = b if a == m.start() else at
                break


def mask_text(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms and (kind, start, end) of what was replaced, in the text given."""
    if not text:
        return text, []
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        for m in _MAIL.finditer(text):
            local = m.group()[:-1]
            found.append((m.start(), m.end() - 1, "email", pseudonym("email", local, key, back)))
    if _DIGIT.search(text):
        taken = {at for a, b, *_ in found for at in range(a, b)}
        found += _numbers(text, key, back, taken)
    if not found:
        return text, []
    found.sort()
    out, at = [], 0
    for a, b, _, fresh in found:
        out += [text[at:a], fresh]
        at = b
    return "".join([*out, text[at:]]), [(kind, a, b) for a, b, kind, _ in found]


def mask_documents(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The documents with pseudonyms in ``text``; all other columns as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fresh = pa.array([mask_text(t, key)[0] for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.record_batch([fresh if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, n_<kind>..., n_found, spans, masked_sha256): what was replaced in each document row.

    The spans are (kind, start, end) in characters of the text; ``masked_sha256`` is of the masked text's UTF-8 bytes.
    """

    def run(batch: pa.RecordBatch) -> list:
        spans, shas = [], []
        for t in batch.column(1).to_pylist():
            masked, found = mask_text(t, key)
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            shas.append(hashlib.sha256((masked or "").encode("utf-8", "surrogatepass")).hexdigest())
        counts = [[sum(s["kind"] == k for s in row) for row in spans] for k in KINDS]
        return [batch.column(0), *counts, [len(s) for s in spans], spans, shas]

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_rows(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {kind}, {counts}, n_found bigint, spans array<struct<kind:string,start:int,end:int>>, masked_sha256 string")
