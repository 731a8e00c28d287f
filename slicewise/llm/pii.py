"""Format-preserving pseudonyms for personal numbers and dates, by a keyed Feistel permutation.

Found and validated values: payment cards (13 to 19 digits, Luhn), IBANs (mod 97),
US social security numbers (area, group and serial ranges), telephone numbers
(international or North American form), IPv4 addresses (octet ranges) and calendar dates. Each value is
mapped to its rank within its format (all cards of that length, all dates of two centuries
whose day and month have as many digits and that read the same way, ...), the rank is permuted by a balanced Feistel network over its
bits, walked until it falls into the format again, and the new rank is
written with the old value's separators. So a card stays a valid card, a date a
date, equal values get equal pseudonyms in every document (also when written
with other separators), different values different ones, and `restore` inverts
it with the key. The local part of an e-mail address is permuted likewise, letter for letter and
digit for digit.

Nothing is shuffled: a document's pseudonyms depend on its text and the key only.

Defined cases: null text stays null with no values; empty text stays empty; empty
table: empty result; repeated rows get equal texts; null ids are carried along;
only doc_id and text are read, so further columns play no part. Whole texts are
searched, whatever their length; patterns have bounded repeats, so the time is
linear in the text.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Key of the registered query; a real run passes its own secret.
DEMO_KEY = b"pseudonym-demo-key"
ROUNDS = 10

_DAY0 = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _DAY0 + 1
# English month names.
_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
# ITU country codes of two digits; 1 and 7 have one, all others three.
_TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
                             "81 82 84 86 90 91 92 93 94 95 98".split())


class Feistel:
    """A keyed permutation of range(size) for every (kind, size)."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.sha256(key).digest(), rounds

    def _f(self, half: int, i: int, tweak: bytes, bits: int) -> int:
        data = tweak + bytes([i]) + half.to_bytes((bits + 7) // 8, "big")
        n = (bits + 7) // 8
        out = b"".join(hashlib.blake2b(data + bytes([b]), key=self.key, digest_size=min(64, n)).digest() for b in range(-(-n // 64)))
        return int.from_bytes(out[:n], "big") & ((1 << bits) - 1)

    def _once(self, x: int, tweak: bytes, bits: int, back: bool) -> int:
        left, right = x >> bits, x & ((1 << bits) - 1)
        if back:
            for i in reversed(range(self.rounds)):
                left, right = right ^ self._f(left, i, tweak, bits), left
        else:
            for i in range(self.rounds):
                left, right = right, left ^ self._f(right, i, tweak, bits)
        return left << bits | right

    def permute(self, x: int, size: int, kind: str, back: bool = False) -> int:
        if not 0 <= x < size:
            raise ValueError("rank outside its format")
        bits = max(1, -(-(size - 1).bit_length() // 2))
        tweak = f"{kind}:{size}:".encode()
        while True:                                   # cycle walking: the domain is under 4 x size
            x = self._once(x, tweak, bits, back)
            if x < size:
                return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _fill(shape: str, digits: str) -> str:
    """The digits put where `shape` has digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _card(v: str, p: Callable) -> str | None:
    d = re.sub(r"\D", "", v)
    if len(set(d)) == 1 or luhn_digit(d[:-1]) != d[-1]:
        return None
    new = str(p(int(d[:-1]), 10 ** (len(d) - 1), f"card{len(d)}")).zfill(len(d) - 1)
    return _fill(v, new + luhn_digit(new))


def _iban_check(country: str, bban: str) -> str:
    return str(98 - int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97).zfill(2)


def _mixed(text: str, p: Callable, kind: str) -> str:
    """Digits stay digits and letters letters (case kept); everything else stays."""
    places = [10 if c.isdigit() else 26 for c in text if c.isascii() and c.isalnum()]
    size, rank = 1, 0
    for base, c in zip(places, (c for c in text if c.isascii() and c.isalnum()), strict=True):
        rank = rank * base + (int(c) if c.isdigit() else ord(c.lower()) - 97)
        size *= base
    if size == 1:
        return text
    # the layout is a part of the kind, so values of one layout are permuted among themselves
    layout = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", text)))
    rank, out = p(rank, size, f"{kind}:{layout.lower()}"), []
    for base in reversed(places):
        rank, d = divmod(rank, base)
        out.append(str(d) if base == 10 else chr(97 + d))
    it = iter(reversed(out))
    return "".join((n.upper() if c.isupper() else n) if c.isascii() and c.isalnum() and (n := next(it)) else c for c in text)


def _iban(v: str, p: Callable) -> str | None:
    flat = v.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _iban_check(flat[:2], flat[4:]) != flat[2:4]:
        return None
    bban = _mixed(flat[4:], p, "iban" + flat[:2])
    new = iter(flat[:2] + _iban_check(flat[:2], bban) + bban)
    return "".join(c if c == " " else next(new) for c in v)


def _ssn(v: str, p: Callable) -> str | None:
    a, g, s = map(int, (v[:3], v[4:6], v[7:]))
    if not (1 <= a <= 899 and a != 666 and g and s):
        return None
    rank = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1
    rank, s = divmod(p(rank, 898 * 99 * 9999, "ssn"), 9999)
    a, g = divmod(rank, 99)
    a += 1 + (a >= 665)
    return f"{a:03d}{v[3]}{g + 1:02d}{v[6]}{s + 1:04d}"


def _country(digits: str) -> str:
    """The country code that an international number starts with, however it is written."""
    return digits[:1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGIT_CODES else 3]


def _phone(v: str, p: Callable) -> str | None:
    digits = re.sub(r"\D", "", v)
    code = _country(digits)
    trunk = re.match(rf"\+{code}[ .-]?\(0\)", v)          # a zero that is only dialled inside the country
    rest = digits[len(code) + bool(trunk):]
    if not 8 <= len(code) + len(rest) <= 15:
        return None
    if rest[0] == "0":                                    # part of the number (Italy); it stays
        new = "0" + str(p(int(rest), 10 ** (len(rest) - 1), f"phone+{code}:0{len(rest)}")).zfill(len(rest) - 1)
    else:
        low, size = 10 ** (len(rest) - 1), 9 * 10 ** (len(rest) - 1)    # the first digit stays above 0
        new = str(low + p(int(rest) - low, size, f"phone+{code}:{len(rest)}"))
    return _fill(v, code + "0" * bool(trunk) + new)


def _local_phone(v: str, p: Callable) -> str | None:
    """North American numbers without a country code: area and exchange start with 2 to 9."""
    d = re.sub(r"\D", "", v)
    if d[0] < "2" or d[3] < "2" or (v[0] == "(") != (")" in v):
        return None
    rank = ((int(d[:3]) - 200) * 800 + int(d[3:6]) - 200) * 10_000 + int(d[6:])
    rank, line = divmod(p(rank, 800 * 800 * 10_000, "phone local"), 10_000)
    area, exchange = divmod(rank, 800)
    return _fill(v, f"{area + 200}{exchange + 200}{line:04d}")


def _ipv4(v: str, p: Callable) -> str | None:
    parts = v.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    return ".".join(map(str, p(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ipv4").to_bytes(4, "big")))


def _date(v: str, p: Callable) -> str | None:
    parts = re.split(r"([-/. ,]+)", v)
    word = next((i for i in (0, 2) if parts[i][:1].isalpha()), None)
    try:
        if word is not None:
            names = [m.lower() for m in _MONTHS]
            month, (day, year) = names.index(parts[word].lower()) + 1, (parts[2 - word], parts[4])
            order = "mdy" if word == 0 else "dmy"
        elif len(parts[0]) == 4:
            order, (year, month, day) = "ymd", parts[::2]
        elif int(parts[2]) > 12:
            order, (month, day, year) = "mdy", parts[::2]
        else:
            order, (day, month, year) = "dmy", parts[::2]
        rank = datetime.date(int(year), int(month), int(day)).toordinal() - _DAY0
    except ValueError:
        return None
    if not 0 <= rank < _DAYS:
        return None
    # within the dates that read the same way: day and month keep their number of digits, and a day beyond 12 stays beyond 12
    same = _alike_days(_day_class(rank))
    d = datetime.date.fromordinal(same[p(bisect_left(same, rank), len(same), f"date{_day_class(rank)}")] + _DAY0)
    wide = lambda n, old: f"{n:0{len(old)}d}"
    put = {"y": f"{d.year:04d}", "m": _MONTHS[d.month - 1] if word is not None else wide(d.month, month), "d": wide(d.day, day)}
    parts[::2] = [put[c] for c in order]
    return "".join(parts)


def _day_class(rank: int) -> int:
    d = datetime.date.fromordinal(rank + _DAY0)
    return (d.day > 9) + (d.day > 12) + 3 * (d.month > 9)


@cache
def _alike_days(kind: int) -> list[int]:
    return [r for r in range(_DAYS) if _day_class(r) == kind]


def _email(v: str, p: Callable) -> str | None:
    local, at, domain = v.rpartition("@")
    return _mixed(local, p, "email") + at + domain


_MONTH = "|".join(_MONTHS)
#: kind, pattern (no capture groups), what writes the pseudonym; the first that fits and is valid wins.
KINDS: list[tuple[str, str, Callable]] = [
    ("email", r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9.-]{0,200}\.[A-Za-z]{2,24}(?![\w@])", _email),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", _iban),
    ("date", r"(?<![\w.])(?:\d{4}-\d{2}-\d{2}(?=[Tt]\d{2})|(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\w-]))", _date),
    ("date", rf"(?<!\w)(?:(?:{_MONTH}) \d{{1,2}}, \d{{4}}|\d{{1,2}} (?:{_MONTH}) \d{{4}})(?!\w)", _date),
    ("ssn", r"(?<![\w-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-])", _ssn),
    ("phone", r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,4}){2,5}(?!\w)", _phone),
    ("phone", r"(?<![\w+.-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-])", _local_phone),
    ("ipv4", r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\w)", _ipv4),
    ("card", r"(?<![\w-])\d{4}(?:[ -]?\d{4}){2}(?:[ -]?\d{1,4}){1,2}(?![\w-])|(?<![\w-])\d{13,19}(?![\w-])|(?<![\w-])\d{4}[ -]\d{6}[ -]\d{5}(?![\w-])", _card),
]


class Pseudonyms:
    def __init__(self, key: bytes, back: bool = False):
        feistel = Feistel(key)
        self.permute = lambda rank, size, kind: feistel.permute(rank, size, kind, back)
        self.number = [(k, re.compile(p), f) for k, p, f in KINDS if k != "email"]
        self.email = next((k, re.compile(p), f) for k, p, f in KINDS if k == "email")
        self.start = re.compile(r"[0-9]")

    def _spans(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """Valid values from left to right, none overlapping: start, end, kind, pseudonym."""
        found, taken = [], 0
        # e-mail addresses stand around an @; everything else has a digit, and starts at most a few places before one
        at = text.find("@")
        kind, pattern, write = self.email
        while at >= 0:
            begin = at
            while begin > 0 and at - begin < 64 and (text[begin - 1].isascii() and text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
                begin -= 1
            for m in [pattern.search(text, begin, min(len(text), at + 260))]:
                if m and m.start() <= at < m.end():
                    found.append((m.start(), m.end(), kind, write(m.group(), self.permute)))
            at = text.find("@", at + 1)
        mails = [(b, e) for b, e, _, _ in found]
        k, m = 0, self.start.search(text)
        while m:
            i = m.start()
            while k < len(mails) and mails[k][1] <= i:
                k += 1
            if k < len(mails) and mails[k][0] <= i:
                i = mails[k][1]
                m = self.start.search(text, i)
                continue
            end = None
            back = 1 if i and text[i - 1] in "+(" else 2 if i > 1 and text[i - 2:i].isalpha() else 0
            begins = [i - back, i] if back else [i]
            if i > 1 and text[i - 1] == " " and text[i - 2].isalpha():   # a month's name before its day
                begin = i - 1
                while begin > max(taken, i - 11) and text[begin - 1].isalpha():
                    begin -= 1
                begins.insert(0, begin)
            for begin in dict.fromkeys(b for b in begins if b >= taken):
                for kind, pattern, write in self.number:
                    if (v := pattern.match(text, begin)) and v.end() > i and (new := write(v.group(), self.permute)) is not None:
                        found.append((begin, v.end(), kind, new))
                        end = taken = v.end()
                        break
                if end:
                    break
            if not end:                                  # go past this run of digits
                end = i + 1
                while end < len(text) and text[end].isdigit():
                    end += 1
            m = self.start.search(text, end)
        return iter(sorted(found))

    def apply(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The new text, and kind, start and length of every value in the old one."""
        if text is None:
            return None, []
        out, spans, at = [], [], 0
        for begin, end, kind, new in self._spans(text):
            if begin < at:
                continue
            out += [text[at:begin], new]
            spans.append((kind, begin, end - begin))
            at = end
        return ("".join([*out, text[at:]]) if spans else text), spans


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """doc_id, text (with pseudonyms), spans (kind, start and length in the old text); back: with the real values again."""

    @F.pandas_udf("text string, spans array<struct<kind: string, start: int, length: int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work = Pseudonyms(key, back)
        for texts in batches:
            done = [work.apply(t) for t in texts]
            yield pd.DataFrame({"text": [t for t, _ in done],
                                "spans": [[{"kind": k, "start": b, "length": n} for k, b, n in s] for _, s in done]})

    return docs.select("doc_id", run("text").alias("_r")).select("doc_id", "_r.text", "_r.spans")


def restore(docs: DataFrame, key: bytes) -> DataFrame:
    """The original texts of `pseudonymise`'s result."""
    return pseudonymise(docs, key, back=True)


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_values, kinds (distinct, sorted, comma-joined)."""
    return (pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)
            .select("doc_id", "text", F.size("spans").cast("long").alias("n_values"),
                    F.array_join(F.array_sort(F.array_distinct("spans.kind")), ",").alias("kinds")))
