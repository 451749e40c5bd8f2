"""The permutations of personal data against a plain Python twin."""

import datetime
import hashlib
import random

from kernelloom.llm import pseudonyms

KEY = "a master key of the test"
SUB = pseudonyms.subkeys(KEY)


def digest(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def rounds(a, b, size_a, size_b, key, tweak):
    for i in range(pseudonyms.ROUNDS):
        if i % 2 == 0:
            a = (a + int(digest(key, tweak, i, b)[:15], 16) % size_a) % size_a
        else:
            b = (b + int(digest(key, tweak, i, a)[:15], 16) % size_b) % size_b
    return a, b


def digits_of(d, kind):
    if len(d) < 2:
        return d
    u = len(d) // 2
    v = len(d) - u
    a, b = rounds(int(d[:u]), int(d[u:]), 10**u, 10**v, SUB[kind], f"{kind}{len(d)}")
    return f"{a:0{u}d}{b:0{v}d}"


def walked(d, kind, fits):
    d = digits_of(d, kind)
    while not fits(d):
        d = digits_of(d, kind)
    return d


def filled(text, digits):
    rest = iter(digits)
    return "".join(next(rest) if c in "0123456789" else c for c in text)


def plain(text):
    return "".join(c for c in text if c in "0123456789")


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10


def card(text):
    new = digits_of(plain(text)[:-1], "card")
    return filled(text, new + str(-luhn(new + "0") % 10))


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(text):
    bare = text.replace(" ", "").upper()
    account = filled(bare[4:], digits_of(plain(bare[4:]), "iban"))
    return filled(text, f"{98 - mod97(account + bare[:2] + '00'):02d}" + plain(account))


def day(text, form):
    first = datetime.date(1800, 1, 1)
    n = (datetime.datetime.strptime(text, form).date() - first).days
    a, b = rounds(n // 5411, n % 5411, 27, 5411, SUB["date"], "date")
    made = first + datetime.timedelta(a * 5411 + b)
    return form.replace("%Y", f"{made.year:04d}").replace("%m", f"{made.month:02d}").replace("%d", f"{made.day:02d}")


def ip(text):
    p = list(map(int, text.split(".")))
    a, b = rounds(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, SUB["ip"], "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def letters(text, kind, m=26):
    u = len(text) // 2
    halves = [text[:u], text[u:]]
    for i in range(pseudonyms.ROUNDS):
        own, other = halves[i % 2], halves[1 - i % 2]
        drawn = "".join(digest(SUB[kind], kind, len(text), i, b, other) for b in range((len(own) + 15) // 16))
        out = []
        for p, c in enumerate(own):
            by = int(drawn[4 * p : 4 * p + 4], 16)
            for low, size in (("0", 10), ("a", m), ("A", m)):
                if 0 <= ord(c) - ord(low) < size:
                    c = chr(ord(low) + (ord(c) - ord(low) + by) % size)
                    break
            out.append(c)
        halves[i % 2] = "".join(out)
    return "".join(halves)


def email(text):
    name, _, host = text.rpartition("@")
    return letters(name, "email") + "@" + host


def behind(text, n, kind, fits=lambda d: True):
    d = plain(text)
    return filled(text, d[:n] + walked(d[n:], kind, fits))


def area(d):
    return d[0] in "23456789" and d[1:3] != "11"


def ssn(d):
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def test_every_format_equals_its_twin(spark):
    rng = random.Random(9)
    cases = []
    for _ in range(12):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        number = body + str(-luhn(body + "0") % 10)
        cases.append((" ".join(number[i : i + 4] for i in range(0, 16, 4)), card))
        account = "".join(rng.choice("0123456789") for _ in range(18))
        bban = f"{98 - mod97(account + 'DE00'):02d}"
        cases += [(f"DE{bban}{account}", iban), (f"de{bban}{account}", iban)]
        d = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(50_000))
        cases += [(d.isoformat(), lambda t: day(t, "%Y-%m-%d")), (d.strftime("%Y/%m/%d"), lambda t: day(t, "%Y/%m/%d")), (d.strftime("%d.%m.%Y"), lambda t: day(t, "%d.%m.%Y"))]
        cases.append((".".join(str(rng.randrange(256)) for _ in range(4)), ip))
        cases.append((f"({rng.randrange(230, 299)}) {rng.randrange(200, 999)}-{rng.randrange(10_000):04d}", lambda t: behind(t, 0, "phone", area)))
        cases.append((f"+33 6 {rng.randrange(10, 99)} {rng.randrange(10, 99)} {rng.randrange(10, 99)} {rng.randrange(10, 99)}", lambda t: behind(t, 2, "intl", lambda d: d[0] != "0")))
        cases.append((f"06 {rng.randrange(10, 99)} {rng.randrange(10, 99)} {rng.randrange(10, 99)} {rng.randrange(10, 99)}", lambda t: behind(t, 2, "trunk")))
        cases.append((f"030 {rng.randrange(10**5, 10**8)}", lambda t: behind(t, 2, "trunk")))
        cases.append((f"{rng.randrange(1, 600):03d}-{rng.randrange(1, 99):02d}-{rng.randrange(1, 9999):04d}", lambda t: behind(t, 0, "ssn", ssn)))
        cases.append((rng.choice(["Jürgen", "anna.b9", "x", "müller.hans"]) + f"{rng.randrange(99)}@" + rng.choice(["exämple.de", "mail.example.org"]), email))
        cases.append(("AKIA" + "".join(rng.choice("ABCXYZ0189") for _ in range(16)), lambda t: "AKIA" + letters(t[4:], "key")))
        cases.append((":".join(f"{rng.randrange(1, 65536):x}" for _ in range(8)), lambda t: letters(t, "ipv6", 6)))
        cases.append((f"2001:db8::{rng.randrange(1, 65536):x}", lambda t: letters(t, "ipv6", 6)))
    df = spark.createDataFrame([(i, f"see {t} there") for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    made = pseudonyms.pseudonymise(df, KEY)
    got = {r.doc_id: r.text for r in made.collect()}
    assert [got[i] for i in range(len(cases))] == [f"see {twin(t)} there" for t, twin in cases]
    # the master key isn't in any plan
    assert KEY not in made._jdf.queryExecution().toString()


def test_national_numbers_keep_their_zero(spark):
    df = spark.createDataFrame([(0, "+49 030 1234567"), (1, "+33612345678")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pseudonyms.pseudonymise(df, KEY).collect()}
    assert got[0].startswith("+49 0") and got[0] != "+49 030 1234567" and got[1][:3] == "+33" and got[1][3] != "0"
