"""Operator 7: format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Found are card numbers (13 to 19 digits that pass Luhn), IBANs (mod 97), social
security numbers, phone numbers, IPv4 addresses, dates of 1900 to 2099 and e-mail
addresses. What fails its validation stays as it is. A value becomes a whole number
in the range of its format, a Feistel network permutes that range (walking on while
the result lies outside), and the result is written in the same format: separators,
length and case stay, check digits are right again, dates are dates. Phones are the
North American form, with or without brackets, and any grouping behind + and a country
code. Dates are year, day or month first (month first where day first is no date) with
one or two digits, or have an English month's name; a date is permuted among those that
its way of writing can hold, so it reads the same way afterwards. The key and the
kind choose the permutation, not the document, so equal values get equal pseudonyms
everywhere, whatever their separators and, in e-mail names, their case; restore() inverts
it with the same key. A phone's country code stays, as the digits behind + tell it; a number
without one is linked to the same number behind +1.

A null text counts as empty. Rows are handled one by one, so nulls, repeated rows and
an empty table need no rule of their own; other columns are left out.
"""

from __future__ import annotations

import datetime
import hmac
import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole_text

#: Key of the registered query; a user passes their own.
KEY = b"public-demonstration-key"
ROUNDS, CACHE = 8, 100_000
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: May is its whole name, so a short name never becomes it.
_SHORT = {m[:3]: i for i, m in enumerate(_MONTHS, 1) if m != "may"}
_NAMED = "|".join(f(m) for m in [*_MONTHS, *_SHORT] for f in (str.title, str.lower, str.upper))
#: One alternative a kind, tried in this order at each place.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w%+-]+(?:\.[\w%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w))"
    r"|(?P<phone>(?:(?<![\w+])\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?|(?<!\w)\([0-9]{3}\) ?)"
    r"(?:[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{2}[ .-][0-9]{2}|[0-9]{2,4}[ .-][0-9]{3,4})(?!\w)(?!-[0-9])"
    r"|(?<![\w+])\+(?:[0-9]{10,15}|[0-9]{1,3}[ .-][0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4})(?!\w)(?!-[0-9])"
    r"|(?<![\w+])(?<![0-9][.-])(?:1[ .-])?[0-9]{3}(?P<sep>[ .-])[0-9]{3}(?P=sep)[0-9]{4}(?!\w)(?![.-][0-9])"
    r"|(?<![\w+])\+[0-9]{1,3}(?P<sep2>[ .-])[0-9]{1,5}(?:(?P=sep2)[0-9]{2,8}){1,5}(?!\w)(?![.-][0-9]))"
    rf"|(?P<date>(?<![\w.-])(?:(?:19|20)[0-9]{{2}}(?:(?P<cut>[.-])[0-9]{{1,2}}(?P=cut)[0-9]{{1,2}}|(?<!/....)/[0-9]{{1,2}}/[0-9]{{1,2}}(?!/))"
    r"|[0-9]{1,2}(?P<cut2>[./-])[0-9]{1,2}(?P=cut2)(?:19|20)[0-9]{2}"
    rf"|[0-9]{{1,2}} (?:{_NAMED})\.?,? (?:19|20)[0-9]{{2}}|(?:{_NAMED})\.? [0-9]{{1,2}},? (?:19|20)[0-9]{{2}})(?![\w-]|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))"
    r"|(?P<card>(?<!\w)(?<![0-9]-)(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{4}(?P<gap2>[ -])[0-9]{6}(?P=gap2)[0-9]{5})(?!\w)(?!-[0-9]))"
)
_MAYBE = re.compile("[0-9@]")


class Feistel:
    """A keyed permutation of 0..size-1, for each (tweak, size)."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, size: int, number: int, half: int, bits: int) -> int:
        data = f"{tweak}:{size}:{number}:{half}".encode()
        return int.from_bytes(hmac.digest(self.key, data, "sha256")[: (bits + 7) // 8], "big") & ((1 << bits) - 1)

    def permute(self, value: int, size: int, tweak: str, back: bool = False) -> int:
        if size < 2:
            return value
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:
            left, right = value >> bits, value & ((1 << bits) - 1)
            for number in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = right ^ self._round(tweak, size, number, left, bits), left
                else:
                    left, right = right, left ^ self._round(tweak, size, number, right, bits)
            value = left << bits | right
            if value < size:
                return value


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a valid number."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def _refill(shape: str, characters: str) -> str:
    """characters in the places that shape has for ASCII letters and digits."""
    rest = iter(characters)
    return "".join(next(rest) if c.isascii() and c.isalnum() else c for c in shape)


def _mixed_radix(text: str, permute) -> str:
    """Each character stays a digit, small letter or capital; the whole is one number."""
    sets = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text]
    value = size = 0
    for c, s in zip(text, sets, strict=True):
        value, size = value * len(s) + s.index(c), (size or 1) * len(s)
    value = permute(value, size)
    out = []
    for s in reversed(sets):
        value, i = divmod(value, len(s))
        out.append(s[i])
    return "".join(reversed(out))


@lru_cache(64)
def _dates(months: tuple[int, ...], last_month: int, first_day: int, last_day: int) -> list[int]:
    """Ordinals of the dates of 1900 to 2099 within these months and days."""
    days = map(datetime.date.fromordinal, range(_FIRST_DAY, _FIRST_DAY + _DAYS))
    return [d.toordinal() for d in days if d.month in months and d.month <= last_month and first_day <= d.day <= last_day]


def _date(year: str, month: str, day: str) -> int | None:
    try:
        return datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None


def _day(text: str) -> tuple[int, list[int], Callable[[datetime.date], str]] | None:
    """The date, the dates that are written in the same way, and the way."""
    every, most = tuple(range(1, 13)), {1: 9, 2: 31}
    parts = re.findall("[0-9]+", text)
    if name := re.search("[A-Za-z]{3,}", text):
        word = name[0].lower()
        names = _MONTHS if word in _MONTHS else list(_SHORT)
        month = names.index(word) + 1 if names is _MONTHS else _SHORT[word]
        day, year = parts
        case = str.upper if name[0].isupper() else str.lower if name[0].islower() else str.title
        write = lambda d: case(_MONTHS[d.month - 1] if names is _MONTHS else _MONTHS[d.month - 1][:3])
        months = every if names is _MONTHS else tuple(_SHORT.values())
        before, after = text[: name.start()], text[name.end() :]
        renew = lambda t, d: re.sub("[0-9]+", lambda m: f"{d.year}" if len(m[0]) == 4 else f"{d.day:0{len(day)}d}", t)
        found = _date(year, str(month), day)
        dates = _dates(months, 12, 1, most[len(day)])
        return None if found is None else (found, dates, lambda d: renew(before, d) + write(d) + renew(after, d))
    cut = re.search("[^0-9]", text)[0]
    order = "ymd" if len(parts[0]) == 4 else "dmy"
    found = _date(*(parts[order.index(c)] for c in "ymd"))
    low = 1
    if found is None and order == "dmy":
        # the second number is above 12, and stays so
        order, low = "mdy", 13
        found = _date(*(parts[order.index(c)] for c in "ymd"))
    if found is None:
        return None
    width = dict(zip(order, map(len, parts)))
    dates = _dates(every, most[width["m"]], low, most[width["d"]])
    return found, dates, lambda d: cut.join(f"{ {'y': d.year, 'm': d.month, 'd': d.day}[c]:0{width[c]}d}" for c in order)


#: Country codes of one and of two digits; all others have three (fixed values).
_CODES = ["1", "7", "20", "27", *map(str, range(30, 35)), "36", "39", "40", "41", *map(str, range(43, 50)), *map(str, range(51, 59)),
          *map(str, range(60, 67)), "81", "82", "84", "86", *map(str, range(90, 96)), "98"]


def _country_code(plain: str, international: bool) -> int:
    """Digits of the country code, told by the digits alone, so that separators don't matter."""
    if not international:
        return int(len(plain) == 11 and plain[0] == "1")
    return next((n for n in (1, 2) if plain[:n] in _CODES), 3)


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def valid(kind: str, text: str) -> bool:
    plain = re.sub("[^A-Za-z0-9]", "", text)
    if kind == "card":
        return 13 <= len(plain) <= 19 and luhn(plain) == 0 and len(set(plain)) > 1
    if kind == "iban":
        return 15 <= len(plain) <= 34 and plain[2:4] == f"{_iban_check(plain[:2], plain[4:]):02d}"
    if kind == "ssn":
        return plain[:3] not in ("000", "666") and plain[0] != "9" and plain[3:5] != "00" and plain[5:] != "0000"
    if kind == "phone":
        return (8 if text[0] == "+" else 10) <= len(plain) <= 15
    if kind == "ip":
        return all(int(x) < 256 and (x == "0" or x[0] != "0") for x in text.split("."))
    return _day(text) is not None if kind == "date" else True


def pseudonym(kind: str, text: str, cipher: Feistel, back: bool = False) -> str:
    """The pseudonym of a valid value, or with back the value of a pseudonym."""
    permute = lambda value, size, tweak=kind: cipher.permute(value, size, tweak, back)
    plain = re.sub("[^A-Za-z0-9]", "", text)
    if kind == "card":
        body = f"{permute(int(plain[:-1]), 10 ** (len(plain) - 1)):0{len(plain) - 1}d}"
        return _refill(text, body + str(-luhn(body + "0") % 10))
    if kind == "iban":
        body = _mixed_radix(plain[4:], permute)
        return _refill(text, f"{plain[:2]}{_iban_check(plain[:2], body):02d}{body}")
    if kind == "ssn":
        # areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999
        area, group, serial = int(plain[:3]), int(plain[3:5]), int(plain[5:])
        value = permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
        value, serial = divmod(value, 9999)
        area, group = divmod(value, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "phone":
        keep = _country_code(plain, text[0] == "+")
        return _refill(text, plain[:keep] + f"{permute(int(plain[keep:]), 10 ** (len(plain) - keep)):0{len(plain) - keep}d}")
    if kind == "ip":
        value = permute(int.from_bytes(bytes(map(int, text.split("."))), "big"), 1 << 32)
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "date":
        day, dates, write = _day(text)
        return write(datetime.date.fromordinal(dates[permute(bisect_left(dates, day), len(dates))]))
    name, host = text.rsplit("@", 1)
    letters = re.sub("[^A-Za-z0-9]", "", name)
    # the case is not part of the value; each letter takes that of its place
    new = "".join(n.upper() if c.isupper() else n for n, c in zip(_mixed_radix(letters.lower(), permute), letters, strict=True)) if letters else ""
    return _refill(name, new) + "@" + host


def _replacer(key: bytes, back: bool = False):
    cipher = Feistel(key)
    swapped = lru_cache(CACHE)(lambda kind, text: pseudonym(kind, text, cipher, back) if valid(kind, text) else None)

    def scan(text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and (begin, end, kind) of what was replaced, in code points of the text as it was."""
        if not _MAYBE.search(text):
            return text, []
        out, spans, at = [], [], 0
        for match in PATTERN.finditer(text):
            new = swapped(match.lastgroup, match[0])
            if new is not None:
                out += [text[at : match.start()], new]
                spans.append((match.start(), match.end(), match.lastgroup))
                at = match.end()
        return "".join([*out, text[at:]]) if spans else text, spans

    return scan


def find(docs: DataFrame, key: bytes = KEY, back: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, spans (kind:begin:end joined by commas) and a count of each kind."""

    def run(batches):
        scan = _replacer(key, back)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = [scan(t) for t in part.column(1).to_pylist()]
                columns = {"doc_id": part.column(0), "text": pa.array([t for t, _ in found], pa.string())}
                columns["spans"] = pa.array([",".join(f"{n}:{a}:{b}" for a, b, n in spans) for _, spans in found], pa.string())
                for kind in KINDS:
                    columns[f"n_{kind}"] = pa.array([sum(n == kind for _, _, n in spans) for _, spans in found], pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, text string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, schema)


def restore(pseudonymised: DataFrame, key: bytes = KEY) -> DataFrame:
    """The texts before find(), given its key: pseudonyms are valid values of their kind and are found again."""
    return find(pseudonymised, key, back=True)


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, spans and counts of every document."""
    return find(documents(spark, sf_dir))
