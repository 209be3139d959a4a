"""Pseudonyms keep formats, link equal values and can be taken back."""

import datetime
import hashlib
import hmac
import ipaddress
import random
import re
import string

from ledgerloom.llm import pseudonyms as P

TEXT = (
    "Call +1 (017) 555-7713 or (212) 555-0000, mail desle.90@mail2.example.com, card 4111 1111 1111 1111 and 4111-1111-1111-1111, "
    "not 4111111111111112; born 1984-02-29 and 31.12.1999, no 1984-02-30; ssn 123-45-6789 not 000-12-3456; host 192.168.0.17, "
    "not 300.1.1.1; iban GB82 WEST 1234 5698 7654 32."
)


def test_formats_and_links():
    text, spans = P._replacer(P.KEY)(TEXT)
    kinds = [k for _, _, k in spans]
    assert kinds == ["phone", "phone", "email", "card", "card", "date", "date", "ssn", "ip", "iban"]
    for kept in ("4111111111111112", "1984-02-30", "000-12-3456", "300.1.1.1", "@mail2.example.com", "+1 ("):
        assert kept in text
    values = [TEXT[a:b] for a, b, _ in spans]
    assert len(text) == len(TEXT) + sum(len(P.pseudonym(k, v, P.Feistel(P.KEY))) - len(v) for k, v in zip(kinds, values))
    new = {v: P.pseudonym(k, v, P.Feistel(P.KEY)) for k, v in zip(kinds, values)}
    for (old, swapped), kind in zip(new.items(), kinds):
        assert swapped != old and P.valid(kind, swapped) and P.pseudonym(kind, swapped, P.Feistel(P.KEY), back=True) == old
        if kind != "ip":
            assert re.sub("[A-Za-z]", "a", re.sub(r"\d", "9", swapped)) == re.sub("[A-Za-z]", "a", re.sub(r"\d", "9", old))
    assert re.sub(r"\D", "", new["4111 1111 1111 1111"]) == re.sub(r"\D", "", new["4111-1111-1111-1111"])
    assert P._replacer(P.KEY, back=True)(text)[0] == TEXT
    assert P._replacer(b"other")(TEXT)[0] != text


def test_neighbours_stay_apart():
    scan = P._replacer(P.KEY)
    for text, kinds in (
        ("4111111111111111 12", ["card"]), ("4111111111111111 4242424242424242", ["card", "card"]), ("+1 (017) 555-7713 129.38.82.176", ["phone", "ip"]),
        ("éleen.34@mail7.example.com###", ["email"]), ("card-4111111111111111", ["card"]), ("+7 (495) 123-45-67", ["phone"]), ("1234567890123456789012", []), ("version 1.2.3.4.5", []),
    ):
        assert [k for _, _, k in scan(text)[1]] == kinds, text


def test_permutations():
    cipher = P.Feistel(b"k")
    for size in (2, 10, 97, 1000):
        assert sorted(cipher.permute(v, size, "t") for v in range(size)) == list(range(size))
        assert all(cipher.permute(cipher.permute(v, size, "t"), size, "t", back=True) == v for v in range(size))
    rng = random.Random(1)
    for _ in range(200):
        ssn = f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        assert P.valid("ssn", P.pseudonym("ssn", ssn, cipher)) and P.pseudonym("ssn", P.pseudonym("ssn", ssn, cipher), cipher, back=True) == ssn


def test_query_and_odd_rows(spark, data):
    rows = P.op7_feistel_pseudonyms(spark, data).collect()
    scan = P._replacer(P.KEY)
    seen = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(seen) and all(r.text == scan(seen[r.doc_id])[0] for r in rows) and sum(r.n_phone + r.n_card for r in rows)
    odd = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, TEXT, "x"), (2, TEXT, "x"), (3, "9" * 100000, "x")], "doc_id long, text string, spans string")
    found = P.find(odd)
    assert sorted(r.text for r in found.collect()) == sorted(["", "", scan(TEXT)[0], scan(TEXT)[0], "9" * 100000])
    assert sorted(r.text for r in P.restore(found).collect()) == sorted(["", "", TEXT, TEXT, "9" * 100000]) and P.find(odd.limit(0)).count() == 0


def test_phones_and_dates_of_other_forms():
    scan, back = P._replacer(P.KEY), P._replacer(P.KEY, back=True)
    phones = ["555-123-4567", "555.123.4567", "555 123 4567", "1-555-123-4567", "+44 20 7946 0958", "+33 1 23 45 67 89", "+49 30 901820", "+65 6123 4567", "+353-1-234-5678"]
    dates = ["12/31/1999", "3/5/1985", "3/25/1985", "13/5/1985", "2020/03/15", "2020.3.5", "2020-3-5", "31-12-1999", "3.5.1985", "5 March 1985", "March 5, 1985", "Mar 15, 1985", "15 MAY 2001", "12 sep 1999"]
    for kind, values in (("phone", phones), ("date", dates)):
        for value in values:
            text = f"It is {value}, or {value}."
            new, spans = scan(text)
            assert [k for _, _, k in spans] == [kind] * 2 and value not in new, value
            assert [text[a:b] for a, b, _ in spans] == [value] * 2
            assert back(new)[0] == text and re.sub(r"\d|[A-Za-z]+", "9", new) == re.sub(r"\d|[A-Za-z]+", "9", text), (value, new)
    rng = random.Random(5)
    for _ in range(2000):
        y, m, d, c = rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 31), rng.choice("./-")
        value = rng.choice([f"{m}{c}{d}{c}{y}", f"{d}{c}{m}{c}{y}", f"{m:02d}{c}{d:02d}{c}{y}", f"{y}{c}{m}{c}{d}", f"{d:02d}{c}{m}{c}{y}"])
        assert back(scan(value)[0])[0] == value
    for text in ("0/5/1985", "31/31/1999", "2020/13/45", "30 February 1999", "http://x.org/a/2020/03/15/b", "555-123-45678", "+1 23"):
        assert scan(text) == (text, []), text


# -- a plain version, written apart from the operator --
def slow_permute(value, size, tweak, key=P.KEY):
    bits = 1
    while 1 << 2 * bits < size:
        bits += 1
    while True:
        left, right = divmod(value, 1 << bits)
        for number in range(8):
            digest = hmac.new(key, f"{tweak}:{size}:{number}:{right}".encode(), hashlib.sha256).digest()
            mask = int.from_bytes(digest[: (bits + 7) // 8], "big") % (1 << bits)
            left, right = right, left ^ mask
        value = left * (1 << bits) + right
        if value < size:
            return value


def slow_digits(digits, tweak):
    return str(slow_permute(int(digits), 10 ** len(digits), tweak)).zfill(len(digits))


def slow_letters(text, tweak):
    alphabets = [string.digits if c in string.digits else string.ascii_lowercase if c in string.ascii_lowercase else string.ascii_uppercase for c in text]
    value, size = 0, 1
    for c, a in zip(text, alphabets):
        value, size = value * len(a) + a.index(c), size * len(a)
    value, out = slow_permute(value, size, tweak), ""
    for a in reversed(alphabets):
        value, k = divmod(value, len(a))
        out = a[k] + out
    return out


def slow_pseudonym(kind, text):
    plain = "".join(c for c in text if c.isascii() and c.isalnum())
    if kind == "ssn":
        areas = [a for a in range(1, 900) if a != 666]
        value = slow_permute((areas.index(int(plain[:3])) * 99 + int(plain[3:5]) - 1) * 9999 + int(plain[5:]) - 1, 898 * 99 * 9999, kind)
        plain = f"{areas[value // 9999 // 99]:03d}{value // 9999 % 99 + 1:02d}{value % 9999 + 1:04d}"
    elif kind == "ip":
        return str(ipaddress.ip_address(slow_permute(int(ipaddress.ip_address(text)), 2**32, kind)))
    elif kind == "card":
        body = slow_digits(plain[:-1], kind)
        doubled = lambda number: sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(number)))
        plain = next(body + d for d in string.digits if doubled(body + d) % 10 == 0)
    elif kind == "iban":
        body = slow_letters(plain[4:], kind)
        number = lambda check: int("".join(str(int(c, 36)) for c in body + plain[:2] + check))
        plain = next(plain[:2] + f"{c:02d}" + body for c in range(2, 99) if number(f"{c:02d}") % 97 == 1)
    elif kind == "phone":
        code = {"+1": 1, "+7": 1, "+44": 2, "+49": 2, "+380": 3}.get(next((c for c in ("+1", "+7", "+44", "+49", "+380") if text.startswith(c)), ""), 0)
        plain = plain[:code] + slow_digits(plain[code:], kind)
    elif kind == "date":
        days = [datetime.date(1900, 1, 1) + datetime.timedelta(k) for k in range(73049)]
        return str(days[slow_permute(days.index(datetime.date.fromisoformat(text)), len(days), kind)])
    else:
        name, host = text.split("@")
        new = iter(slow_letters("".join(c for c in name if c.isalnum()).lower(), kind))
        return "".join((n.upper() if c.isupper() else n) if c.isalnum() and (n := next(new)) else c for c in name) + "@" + host
    rest = iter(plain)
    return "".join(next(rest) if c.isalnum() else c for c in text)


def test_query_equals_the_plain_version(spark):
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice(string.digits) for _ in range(n))

    def value(kind):
        if kind == "ssn":
            return f"{rng.choice([1, 665, 667, 899]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        if kind == "ip":
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            body = "4" + digits(14)
            card = next(body + d for d in string.digits if P.luhn(body + d) == 0)
            return rng.choice(["", " ", "-"]).join(card[k : k + 4] for k in range(0, 16, 4))
        if kind == "iban":
            body = "".join(rng.choice(string.digits + string.ascii_uppercase) for _ in range(18))
            return next(f"GB{c:02d}{body}" for c in range(2, 99) if int("".join(str(int(x, 36)) for x in f"{body}GB{c:02d}")) % 97 == 1)
        if kind == "phone":
            area, one, two = digits(3), digits(3), digits(4)
            return rng.choice([f"+1 ({area}) {one}-{two}", f"+1{area}{one}{two}", f"({area}) {one}-{two}", f"{area}-{one}-{two}", f"+44 20 {digits(4)} {digits(4)}", f"+380{digits(9)}"])
        if kind == "date":
            return str(datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73049)))
        return rng.choice(["Ann.Lee", "bob-7", "X_y.Z9"]) + f"@mail{digits(1)}.example.com"

    rows, want = [], {}
    for i in range(400):
        parts = [(kind, value(kind)) for kind in rng.choices(P.KINDS, k=rng.randint(1, 6))]
        rows.append((i, " ; ".join(f"({v})" if k == "none" else f"has {v} here" for k, v in parts)))
        want[i] = " ; ".join(f"has {slow_pseudonym(k, v)} here" for k, v in parts)
    found = P.find(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in found.collect()} == want
    assert {r.doc_id: r.text for r in P.restore(found.select("doc_id", "text")).collect()} == dict(rows)


def test_equal_values_are_linked():
    new = lambda kind, text: P.pseudonym(kind, text, P.Feistel(P.KEY))
    phones = ["+1 (212) 555-0000", "+12125550000", "+1-212-555-0000", "(212) 555-0000", "212.555.0000", "1-212-555-0000"]
    assert len({re.sub(r"\D", "", new("phone", p))[-10:] for p in phones}) == 1
    abroad = ["+44 20 7946 0958", "+442079460958", "+44 (20) 7946-0958"]
    assert len({re.sub(r"\D", "", new("phone", p)) for p in abroad}) == 1
    names = ["Ann.Lee@Example.com", "ann.lee@example.com", "ANN.LEE@example.com"]
    assert len({new("email", n).lower() for n in names}) == 1 and new("email", names[2]).split("@")[0].isupper()
