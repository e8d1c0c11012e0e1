"""Format-preserving pseudonyms for personal data: a keyed Feistel permutation within each value's format."""

from __future__ import annotations

import hashlib
import re
from datetime import date
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_FIRST_DAY, _LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of 0..n-1 for any n: a balanced Feistel network over the next even number of bits, walked until inside."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, k: int, right: int, tweak: bytes, half: int) -> int:
        data = k.to_bytes(1, "big") + right.to_bytes((half + 7) // 8, "big") + tweak
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=(half + 7) // 8).digest(), "big") & ((1 << half) - 1)

    def _step(self, x: int, tweak: bytes, half: int, back: bool) -> int:
        left, right = x >> half, x & ((1 << half) - 1)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(k, left, tweak, half), left
            else:
                left, right = right, left ^ self._round(k, right, tweak, half)
        return left << half | right

    def permute(self, x: int, n: int, tweak: bytes = b"", back: bool = False) -> int:
        if n < 2:
            return x
        half = ((n - 1).bit_length() + 1) // 2
        tweak += b"/%d" % n
        while True:
            x = self._step(x, tweak, half, back)
            if x < n:
                return x


def _radix(c: str, first: bool) -> tuple[int, int]:
    """Size and least code of a character's class; (1, its code) for one that stays."""
    if "0" <= c <= "9":
        return (9, 49) if first and c != "0" else (10, 48)
    if "a" <= c <= "z":
        return 26, 97
    if "A" <= c <= "Z":
        return 26, 65
    return 1, ord(c)


def permute_text(cipher: Feistel, kind: str, value: str, keep: int = 0, back: bool = False) -> str:
    """Permute digits among digits and ASCII letters among letters of their case; the first `keep` characters and all others stay.

    A number's first digit stays other than 0 if it was.
    """
    digits = [i for i, c in enumerate(value) if i >= keep and "0" <= c <= "9"]
    classes = [(1, ord(c)) if i < keep else _radix(c, bool(digits) and i == digits[0]) for i, c in enumerate(value)]
    total, x = 1, 0
    for (size, least), c in zip(classes, value):
        total, x = total * size, x * size + ord(c) - least
    x = cipher.permute(x, total, f"{kind}/{total}".encode(), back)
    out = []
    for size, least in reversed(classes):
        x, rest = divmod(x, size)
        out.append(chr(least + rest))
    return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    """The digit that makes digits + it pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    """The two check digits of an IBAN."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _fill(shape: str, digits: str) -> str:
    """Put digits (or letters) back among the separators of a value."""
    left = iter(digits)
    return "".join(next(left) if c.isalnum() else c for c in shape)


def _card(cipher: Feistel, value: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
        return None
    body = permute_text(cipher, "card", digits[:-1], back=back)
    return _fill(value, body + luhn_digit(body))


def _iban(cipher: Feistel, value: str, back: bool) -> str | None:
    raw = re.sub(r"\s", "", value)
    country, account = raw[:2], raw[4:]
    if not 15 <= len(raw) <= 34 or iban_digits(country, account) != raw[2:4]:
        return None
    account = permute_text(cipher, "iban" + country, "0" + account, keep=1, back=back)[1:]
    return _fill(value, country + iban_digits(country, account) + account)


def _phone(cipher: Feistel, value: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", value)
    country = re.match(r"\+\d{1,3}(?=[ ().-])", value)
    if not 10 <= len(digits) <= 15:
        return None
    return permute_text(cipher, "phone", value, keep=country.end() if country else 0, back=back)


def _ip(cipher: Feistel, value: str, back: bool) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = cipher.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(cipher: Feistel, value: str, back: bool) -> str | None:
    area, group, serial = (int(p) for p in value.split("-"))
    if not _ssn_valid(area) or not group or not serial:
        return None
    # 898 areas, 99 groups, 9999 serials
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(cipher.permute(x, 898 * 99 * 9999, b"ssn", back), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ssn_valid(area: int) -> bool:
    return 0 < area < 900 and area != 666


def _date(cipher: Feistel, value: str, back: bool) -> str | None:
    sep = re.search(r"\D", value).group()
    parts = value.split(sep)
    year_first = len(parts[0]) == 4
    order = (0, 1, 2) if year_first else (2, 1, 0) if sep != "/" or int(parts[0]) > 12 else (2, 0, 1)
    try:
        day = date(*(int(parts[i]) for i in order)).toordinal()
    except ValueError:
        return None
    if not _FIRST_DAY <= day <= _LAST_DAY:
        return None
    # permuted among the dates that are written alike: which part comes first must still be plain, and parts of one digit stay so
    short = len(parts[order[1]]) == 1 or len(parts[order[2]]) == 1
    month_day = sep == "/" and not year_first and order == (2, 0, 1)
    day_month = sep == "/" and not year_first and not month_day

    def alike(n: int) -> bool:
        d = date.fromordinal(n)
        if day_month and d.day <= 12:
            return False
        return not short or (len(str(d.month)), len(str(d.day))) == (len(parts[order[1]]), len(parts[order[2]]))

    tweak = f"date/{day_month}/{short and (len(parts[order[1]]), len(parts[order[2]]))}".encode()
    while True:
        day = _FIRST_DAY + cipher.permute(day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, tweak, back)
        if alike(day):
            break
    new = date.fromordinal(day)
    width = 1 if short else 2
    texts = {0: f"{new.year:04d}", 1: f"{new.month:0{width}d}", 2: f"{new.day:0{width}d}"}
    return sep.join(texts[order.index(i)] for i in range(3))


def _email(cipher: Feistel, value: str, back: bool) -> str | None:
    name, _, domain = value.rpartition("@")
    host, _, top = domain.rpartition(".")
    if not name or not host:
        return None
    new = permute_text(cipher, "email", f"{name}@{host}", back=back)
    return f"{new}.{top}"


#: Each kind: what a value looks like, and how it is validated and permuted. The first kind in order that fits a stretch takes it.
KINDS = {
    "email": (re.compile(r"(?<![\w.%+-])[A-Za-z0-9_][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,63}(?![\w-])"), _email),
    "iban": (re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), _iban),
    "ip": (re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"), _ip),
    "date": (re.compile(r"(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?!(?!T\d\d:?\d\d)[\w/-]|\.\d)"), _date),
    "ssn": (re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), _ssn),
    "card": (re.compile(r"(?<![\w.+-])\d+(?:[ -]\d+)*(?![\w-])"), _card),
    "phone": (re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])|(?<![\w.])\+\d{1,3}(?:[ .-]?\d){8,12}(?![\w-])"), _phone),
}

#: Characters of an IBAN by country. A number of another length is sought after that of this length.
IBAN_LENGTH = {c: int(n) for n, some in (p.split(":") for p in (
    "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in some.split(",")}  # fmt: skip
_DIGITS, _PARTS = re.compile(r"\d+"), re.compile(r"[A-Z0-9]+")


def _walked(change, cipher: Feistel, value: str, back: bool, alike) -> str | None:
    """The pseudonym of a value beside others: the next ones of the cipher are passed over until what lies around is read alike, as undoing needs."""
    new = change(cipher, value, back)
    while new is not None and not alike(new):
        new = change(cipher, new, back)
    return new


def _next_card(number, spans: list[tuple[int, int]], low: int, stop: int, whole: bool, free) -> tuple[int, int] | None:
    """First and last + 1 of the parts of the next card number from low on: all parts if whole, else the first end, and for it the first start.

    number gives the digits of a part, spans its place.
    """
    sizes = [b - a for a, b in spans] if whole else None
    tries = [(0, stop)] if whole and low == 0 else []
    for i, j in chain(tries, ((i, j) for j in range(low + 1, stop + 1) for i in range(max(low, j - 19), j))):
        if 13 <= (sum(sizes[i:j]) if whole else sum(b - a for a, b in spans[i:j])) <= 19 and free(spans[i][0], spans[j - 1][1]):
            digits = "".join(number(k) for k in range(i, j))
            if digits.strip("0") and luhn_digit(digits[:-1]) == digits[-1]:
                return i, j
    return None


def _cards(cipher: Feistel, text: str, start: int, end: int, back: bool, free):
    """(start, end, pseudonym) of the card numbers in a run of numbers. They and their order depend on nothing that follows a number."""
    spans = [m.span() for m in _DIGITS.finditer(text, start, end)]
    total, low = sum(b - a for a, b in spans), 0
    if total < 13:
        return
    whole = total <= 19

    def number(k: int) -> str:
        return text[spans[k][0] : spans[k][1]]

    while found := _next_card(number, spans, low, len(spans), whole, free):
        i, j = found
        a, b = spans[i][0], spans[j - 1][1]

        def alike(v: str) -> bool:
            """Whether the run reads the same with v in the place of the number."""
            return found == _next_card(  # noqa: B023
                lambda k: v[spans[k][0] - a : spans[k][1] - a] if i <= k < j else number(k), spans, low, len(spans) if whole else j, whole, free  # noqa: B023
            )

        new = _walked(_card, cipher, text[a:b], back, alike)
        if new is not None:
            yield a, b, new
        low = j


def _next_iban(cipher: Feistel, text: str, start: int, end: int, free) -> tuple[int, int] | None:
    """Start and end of the first IBAN that starts in text[start:end]: of its country's length, or else the longest."""
    pattern = KINDS["iban"][0]
    while start < end and (m := pattern.search(text, start)) and m.start() < end:
        ends = [p.end() for p in _PARTS.finditer(text, *m.span())][::-1]
        least = IBAN_LENGTH.get(m.group()[:2])
        ends.sort(key=lambda e: len(re.sub(r"\s", "", text[m.start() : e])) != least)  # noqa: B023
        for e in ends:
            if free(m.start(), e) and _iban(cipher, text[m.start() : e], False) is not None:
                return m.start(), e
        start = _PARTS.match(text, m.start()).end()
    return None


def _ibans(cipher: Feistel, text: str, back: bool, free):
    """(start, end, pseudonym) of the IBANs of a text."""
    low = 0
    while found := _next_iban(cipher, text, low, len(text), free):
        a, b = found
        # one character before and the longest number after b are all that reading up to b can see
        lead, shift = text[max(0, low - 1) : a], max(0, low - 1)
        tail = text[b : b + 64]

        def shifted(x: int, y: int) -> bool:
            return free(x + shift, y + shift)  # noqa: B023

        new = _walked(_iban, cipher, text[a:b], back, lambda v: _next_iban(cipher, lead + v + tail, low - shift, b - shift, shifted) == (a - shift, b - shift))  # noqa: B023
        if new is not None:
            yield a, b, new
        low = b


def find(text: str | None, cipher: Feistel, back: bool = False) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) of all validated values of a whole text, in order, none overlapping. The time follows the length of the text."""
    if not text:
        return []
    found: list[tuple[str, int, int, str]] = []
    taken = bytearray()  # a mark for each character that a value has

    def free(a: int, b: int) -> bool:
        return taken.find(1, a, b) < 0

    def take(kind: str, a: int, b: int, new: str) -> None:
        if not taken:
            taken.extend(bytes(len(text)))
        taken[a:b] = b"\x01" * (b - a)
        found.append((kind, a, b, new))

    for kind, (pattern, change) in KINDS.items():
        if kind == "email" and "@" not in text:
            continue
        if kind == "iban":
            for t in list(_ibans(cipher, text, back, free)):
                take(kind, *t)
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "card":
                if b - a >= 13:
                    for t in list(_cards(cipher, text, a, b, back, free)):
                        take(kind, *t)
            elif free(a, b):
                new = change(cipher, m.group(), back)
                if new is not None:
                    take(kind, a, b, new)
    return sorted(found, key=lambda t: t[1])


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """Every document with its personal data replaced: doc_id, text, n_found, found (array of kind, start, end in the original).

    E-mail addresses (up to 64 characters before the @), IBANs (check digits valid), IPv4 addresses, calendar dates from 1900 to 2099, US social security numbers, card numbers
    (Luhn valid) and phone numbers are each permuted among the values of their own format by a Feistel cipher with `key`, so equal values
    become equal pseudonyms in all documents, pseudonyms stay valid, and whoever has the key can undo them (back=True). What fails
    validation stays. Where a card number or IBAN stands in a run of others, every part of the run that can be one is tried; if its pseudonym would
    make such a run be read otherwise, the cipher's next one is taken, so there equal values may have different pseudonyms.

    A null text stays null and has nothing found, as an empty one. Repeated rows are treated alike. An empty table gives no rows. Other
    columns aren't read.
    """
    if not 1 <= len(key) <= 64:
        raise ValueError("a key of 1 to 64 bytes")

    def run(batches):
        cipher = Feistel(key)
        for batch in batches:
            texts, counts, spans = [], [], []
            for text in batch.column("text").to_pylist():
                found = find(text, cipher, back)
                at, out = 0, []
                for _, a, b, new in found:
                    out += [text[at:a], new]
                    at = b
                texts.append("".join([*out, text[at:]]) if found else text)
                counts.append(len(found))
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b, _ in found])
            span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(spans, span)], ["doc_id", "text", "n_found", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, text string, n_found int, found array<struct<kind:string,start:int,end:int>>")
