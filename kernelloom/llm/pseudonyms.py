"""Personal data replaced by pseudonyms of the same form, with DataFrame functions only.

Validated numbers and dates go through a keyed Feistel permutation of their own format's values: a
card number stays a card number with a right check digit, a date stays a date, a phone number keeps
its country code and punctuation.  A permutation keeps different values of a format different, and equal
values stay linked across documents under one key.

    format   validated by                              permuted
    card     Luhn's check                              all digits but the last, which is computed
    iban     remainder 97                              the account's digits; both check digits are computed
    date     the calendar                              the day, within 400 years from 1800
    ip       four numbers to 255, no version's mark    32 bits
    ipv6     eight groups, or fewer about ``::``       its digits and letters
    phone    area code from 2, not N11                 the ten national digits
    intl     8 to 15 digits behind +                   the digits behind the country code
    trunk    0, area code and number in two groups     the digits behind the first two
    ssn      area not 000, 666 or above 899, no group  nine digits
             or serial of zeros
    email    its punctuation                           the name's letters and digits
    key      AKIA and 16 capitals or digits            the 16 characters
    hex      16 to 64 digits behind = " ' or :         all characters

Letters and digits are permuted within their own kind, so a text's pattern of letters and digits stays; an
e-mail name's letters beyond a-z stay as they are, as does its host.
Where not every value of that many digits is valid, the permutation is applied again until a valid value
comes (cycle walking), which permutes the valid values alone.  A date written day/month/year is read as
month/day where that is a date; the others, with days above 12, are permuted among themselves, so no
output of one reading is one of the other.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelloom.llm.shared import free_names

ROUNDS = 10
#: Steps of a cycle walk; a step fails less than half the time, so a walk of so many never ends short.
WALK = 64
#: 400 Gregorian years from this day are 146097 = 27 * 5411 days.
FIRST_DAY, DAYS = "1800-01-01", (27, 5411)

#: Each format's pattern, in the order in which they are tried at a place: what must stand before it, its
#: own, and what mustn't follow.  Unbounded loops are possessive, so the JVM's matcher doesn't recurse.
PATTERNS = {
    "email": (r"(?<![\p{L}\p{N}._%+-])", r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++", ""),
    "iban": (r"(?<![A-Za-z0-9])", r"(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)", r"(?![A-Za-z0-9])"),
    "key": (r"(?<![A-Za-z0-9])", r"AKIA[0-9A-Z]{16}", r"(?![A-Za-z0-9])"),
    "hex": (r"(?<=[=\"':])", r"(?=[0-9]{0,63}[a-f])[0-9a-f]{16,64}", r"(?![A-Za-z0-9])"),
    "date": (r"(?<![0-9./-])", r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})", r"(?![0-9/-])"),
    "ip": (r"(?<![0-9A-Za-z.])(?<![Vv]ersion |[Vv]ersion: |[Rr]elease )", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", r"(?![0-9]|\.[0-9])"),
    "ipv6": (r"(?<![0-9A-Za-z:.])", r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})", r"(?![0-9A-Za-z:])"),
    "phone": (r"(?<![0-9A-Za-z+])", r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", r"(?![0-9])"),
    "intl": (r"(?<![0-9A-Za-z+])", r"\+[1-9](?:[ .()/-]{0,2}[0-9]){7,14}", r"(?![0-9])"),
    "trunk": (r"(?<![0-9A-Za-z+])", r"(?:0[1-9][0-9]{1,4}[ /-][0-9]{5,8}|0[1-9](?:[ .-][0-9]{2}){4})", r"(?![0-9])"),
    "ssn": (r"(?<![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?![0-9-])"),
    "card": (r"(?<![0-9])", r"[0-9](?:[ -]?[0-9]){12,18}", r"(?![0-9])"),
}
ANY = "|".join(f"(?:{''.join(p)})" for p in PATTERNS.values())


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _power(n: Column) -> Column:
    """10**n, exact for n up to 15."""
    return F.expr("bigint(1)") * F.pow(F.lit(10.0), n).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: Column) -> Column:
    """A struct (a, b): the keyed permutation of the pairs below (left_size, right_size).

    Rounds in turn add to one half, modulo its size, a digest of the other; each is invertible.
    """
    def draw(half: Column, i: Column) -> Column:
        seen = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(seen.cast("binary"), 256), 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + F.pmod(draw(s["b"], i), left_size), left_size)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(draw(s["a"], i), right_size), right_size)).alias("b"),
        )

    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Digits of the same number, 2 to 30 of them."""
    n = F.length(digits)
    u = (n / 2).cast("int")
    v = n - u
    half = feistel(F.substr(digits, F.lit(1), u).cast("long"), F.substr(digits, u + 1, v).cast("long"), _power(u), _power(v), key, F.concat(F.lit(kind), n.cast("string")))
    both = F.transform(F.array(half), lambda h: F.concat(F.lpad(h["a"].cast("string"), u, F.lit("0")), F.lpad(h["b"].cast("string"), v, F.lit("0"))))
    return F.when(n < 2, digits).otherwise(both[0])


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def refill(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced by ``digits``, in order."""
    def fill(new: Column) -> Column:
        def at(i: Column) -> Column:
            c = F.substr(text, i, F.lit(1))
            return F.when(c.between("0", "9"), F.substr(new, F.length(_digits(F.substr(text, F.lit(1), i))), F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), at), "")

    return let(digits, fill)


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum; every second digit from the right is doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def remainder97(text: Column) -> Column:
    """The remainder by 97 of a string of digits and capitals (A = 10 to Z = 35)."""
    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(text, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _card(m: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(m)
    payload = permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = lambda p: (F.lit(10) - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10
    return luhn_sum(digits) % 10 == 0, refill(m, let(payload, lambda p: F.concat(p, check(p).cast("string"))))


def _iban(m: Column, key: str) -> tuple[Column, Column]:
    plain = F.upper(F.replace(m, F.lit(" "), F.lit("")))
    country, account = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    valid = remainder97(F.concat(account, country, F.substr(plain, F.lit(3), F.lit(2)))) == 1
    new = refill(account, permute_digits(_digits(account), key, "iban"))
    check = lambda n: F.lpad((F.lit(98) - remainder97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0")
    return valid, refill(m, let(new, lambda n: F.concat(check(n), _digits(n))))


def walk(value: Column, permute: Callable[[Column], Column], fits: Callable[[Column], Column]) -> Column:
    """``permute`` applied once, and again until the value fits; of values that fit, it permutes these."""
    def step(s: Column, _: Column) -> Column:
        again = let(permute(s["v"]), lambda v: F.struct(v.alias("v"), fits(v).alias("done")))
        return F.when(s["done"], s).otherwise(again)

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(value.alias("v"), F.lit(False).alias("done")), step)["v"]


def permute_day(n: Column, key: str) -> Column:
    """Another of the days since the first, a number."""
    half = feistel((n / DAYS[1]).cast("int"), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, F.lit("date"))
    return let(half, lambda h: (h["a"] * DAYS[1] + h["b"]).cast("int"))


def _date(m: Column, key: str) -> tuple[Column, Column]:
    """Years first, with ``-`` or ``/``; month or day first with ``/`` (month first if that is a date); or day first
    with ``.``."""
    sep, year = F.substr(m, F.lit(3), F.lit(1)), F.substr(m, F.lit(5), F.lit(1))
    forms = [(year == "-", "yyyy-MM-dd"), (year == "/", "yyyy/MM/dd"), (sep == "/", "MM/dd/yyyy"), (sep == "/", "dd/MM/yyyy"), (sep == ".", "dd.MM.yyyy")]
    first = F.lit(FIRST_DAY).cast("date")
    new, valid = F.lit(None).cast("string"), F.lit(False)
    for fits, form in reversed(forms):
        n = F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(form))), first)
        good = F.coalesce(fits & n.between(0, DAYS[0] * DAYS[1] - 1), F.lit(False))
        late = lambda v: F.dayofmonth(F.date_add(first, v)) > 12
        moved = walk(n, lambda v: permute_day(v, key), late) if form == "dd/MM/yyyy" else permute_day(n, key)
        new, valid = F.when(good, F.date_format(F.date_add(first, moved), form)).otherwise(new), good | valid
    return valid, new


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    half = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    new = F.concat_ws(".", *[((half[h] / d).cast("int") % 256).cast("string") for h in "ab" for d in (256, 1)])
    return ~F.exists(part, lambda x: x > 255), new


def _ipv6(m: Column, key: str) -> tuple[Column, Column]:
    return F.lit(True), permute_text(m, key, "ipv6", 6)


def _behind(m: Column, n: Column, new: Callable[[Column], Column]) -> Column:
    """``m`` with its first n digits as they are and ``new`` of the others."""
    digits = _digits(m)
    return refill(m, F.concat(F.substr(digits, F.lit(1), n), new(F.substr(digits, n + 1))))


def _area(ten: Column) -> Column:
    """Whether ten digits begin with an area code."""
    return ten.rlike("^[2-9](?!11)")


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    code = F.length(_digits(m)) - 10
    ten = F.substr(_digits(m), code + 1)
    return _area(ten), _behind(m, code, lambda d: walk(d, lambda v: permute_digits(v, key, "phone"), _area))


def _intl(m: Column, key: str) -> tuple[Column, Column]:
    """The country code is what stands before the first blank or mark, if that is 1 to 3 digits, else two digits."""
    run = F.length(F.regexp_extract(m, r"^\+([0-9]+)", 1))
    code = F.when(run <= 3, run).otherwise(2)
    # no national number begins with 0 behind a country code; a 0 that stands there all the same stays
    code = code + F.substr(_digits(m), code + 1, F.lit(1)).eqNullSafe("0").cast("int")
    sound = lambda d: ~d.startswith("0")
    return F.lit(True), _behind(m, code, lambda d: F.when(sound(d), walk(d, lambda v: permute_digits(v, key, "intl"), sound)).otherwise(permute_digits(d, key, "intl")))


def _trunk(m: Column, key: str) -> tuple[Column, Column]:
    return F.lit(True), _behind(m, F.lit(2), lambda d: permute_digits(d, key, "trunk"))


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    fits = lambda d: d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)")
    return fits(_digits(m)), refill(m, walk(_digits(m), lambda v: permute_digits(v, key, "ssn"), fits))


def permute_text(text: Column, key: str, kind: str, letters: int = 26) -> Column:
    """Each digit another digit and each of the first ``letters`` letters another of its case, as a Feistel
    permutation of all texts with that pattern: rounds in turn shift the characters of one half by a keyed
    digest of the other."""
    n = F.length(text)
    u = (n / 2).cast("int")

    def shifted(half: Column, other: Column, i: Column) -> Column:
        size = F.length(half)
        draw = lambda b: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), i.cast("string"), b.cast("string"), other).cast("binary"), 256)
        # four digits of a digest a character
        drawn = F.array_join(F.transform(F.sequence(F.lit(0), ((size - 1) / 16).cast("int")), draw), "")

        def move(d: Column) -> Column:
            def at(p: Column) -> Column:
                c, by = F.ascii(F.substr(half, p, F.lit(1))), F.conv(F.substr(d, p * 4 - 3, F.lit(4)), 16, 10).cast("int")
                turn = lambda first, m: F.char(first + (c - first + by) % m)
                return F.when(c.between(48, 57), turn(48, 10)).when(c.between(97, 96 + letters), turn(97, letters)).when(c.between(65, 64 + letters), turn(65, letters)).otherwise(F.substr(half, p, F.lit(1)))

            return F.array_join(F.transform(F.sequence(F.lit(1), size), at), "")

        return F.when(size > 0, let(drawn, move)).otherwise(half)

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, shifted(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(shifted(s["b"], s["a"], i)).alias("b"))

    start = F.struct(F.substr(text, F.lit(1), u).alias("a"), F.substr(text, u + 1).alias("b"))
    return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda h: F.concat(h["a"], h["b"]))


def _email(m: Column, key: str) -> tuple[Column, Column]:
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.lit(True), F.concat(permute_text(name, key, "email"), F.lit("@"), host)


def _key(m: Column, key: str) -> tuple[Column, Column]:
    return F.lit(True), F.concat(F.lit("AKIA"), permute_text(F.substr(m, F.lit(5)), key, "key"))


def _hex(m: Column, key: str) -> tuple[Column, Column]:
    return F.lit(True), permute_text(m, key, "hex", 6)


FORMATS = {"email": _email, "iban": _iban, "key": _key, "hex": _hex, "date": _date, "ip": _ip, "ipv6": _ipv6, "phone": _phone, "intl": _intl, "trunk": _trunk, "ssn": _ssn, "card": _card}


def subkeys(key: str) -> dict[str, str]:
    """A key for each format, from which neither the master key nor another format's can be had.  Only these
    stand in a plan; the master key doesn't."""
    return {name: hmac.new(key.encode(), f"kernelloom {name}".encode(), hashlib.sha256).hexdigest()[:32] for name in FORMATS}


def pseudonym(m: Column, keys: dict[str, str]) -> Column:
    """A struct (kind, new) of a match; kind is null, and new the match itself, if it isn't valid."""
    kind, new = F.lit(None).cast("string"), m
    for name in reversed(FORMATS):
        valid, made = FORMATS[name](m, keys[name])
        # the formats' first characters and lengths are cheap to tell apart by their own patterns
        hit = m.rlike(f"^(?:{PATTERNS[name][1]})$") & valid
        kind, new = F.when(hit, F.lit(name)).otherwise(kind), F.when(hit, made).otherwise(new)
    return F.struct(kind.alias("kind"), new.alias("new"))


#: A card's or an IBAN's span ends where its next character isn't a letter or digit.
SPAN_END = "^[A-Za-z0-9](?:[^A-Za-z0-9]|$)"
#: Characters in which the longest card fits: 19 digits, 18 blanks or hyphens, and the one behind them.
CARD_WINDOW = 38


def _shorter(m: Column, window: Column, keys: dict[str, str]) -> Column:
    """A struct (kind, old, new) of the longest valid card or IBAN at the start of an invalid match, or null.

    ``window`` is the text from that start, of which ``m`` may hold less than a card.
    """
    def spans(head: Column) -> Column:
        ends = F.filter(F.sequence(F.length(head), F.lit(12), F.lit(-1)), lambda n: F.substr(head, n, F.lit(2)).rlike(SPAN_END))
        return F.transform(F.when(F.length(head) >= 12, ends), lambda n: F.substr(head, F.lit(1), n))

    def longest(kind: str, head: Column) -> Column:
        fits = f"^(?:{PATTERNS[kind][1]})$"
        span = let(head, lambda h: F.get(F.filter(spans(h), lambda s: s.rlike(fits) & FORMATS[kind](s, keys[kind])[0]), F.lit(0)))
        return let(span, lambda s: F.when(s.isNotNull(), F.struct(F.lit(kind).alias("kind"), s.alias("old"), FORMATS[kind](s, keys[kind])[1].alias("new"))))

    card = F.regexp_extract(window, f"^{PATTERNS['card'][1]}(?![0-9])", 0)
    return F.when(m.rlike("^(?:[A-Z]{2}[0-9]{2}[A-Z0-9 ]+|[a-z]{2}[0-9]{2}[a-z0-9 ]+)$"), longest("iban", m)).when(m.rlike("^[0-9]"), longest("card", card))


def _found(text: Column, starts: Column, matches: Column, keys: dict[str, str]) -> Column:
    """The valid matches, an array of structs (kind, old, new, at, end): at each start the first format's
    longest span that is valid; starts in turn, without those inside a match already taken."""
    def judge(m: Column, at: Column) -> Column:
        whole = let(pseudonym(m, keys), lambda p: F.when(p["kind"].isNotNull(), F.struct(p["kind"].alias("kind"), m.alias("old"), p["new"].alias("new"))))
        best = F.coalesce(whole, _shorter(m, F.substr(text, at, F.lit(CARD_WINDOW)), keys))
        return let(best, lambda b: F.when(b.isNotNull(), F.struct(b["kind"].alias("kind"), b["old"].alias("old"), b["new"].alias("new"), at.alias("at"), (at + F.length(b["old"])).alias("end"))))

    valid = F.filter(F.zip_with(matches, starts, judge), lambda m: m.isNotNull())
    none = F.array().cast("array<struct<kind:string,old:string,new:string,at:int,end:int>>")
    return F.aggregate(valid, none, lambda kept, m: F.when(m["at"] >= F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0)), F.concat(kept, F.array(m))).otherwise(kept))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with new texts and three more columns: n_private, private_kinds (sorted, comma-joined)
    and private_places (array of kind, at: the match's place in the original text, from 1).

    Texts without valid matches are unchanged; null stays null and empty stays empty; very long texts are
    searched whole; repeated rows get equal results; an empty table stays empty.  Columns of those three
    names are replaced, all others stay as they are.
    """
    rows = docs.drop("n_private", "private_kinds", "private_places")
    hit, whole, starts, matches, found = free_names(rows, "hit", "whole", "starts", "matches", "found")
    text, made = F.col(f"`{text_col}`").cast("string"), F.col(found)
    rows = rows.withColumn(hit, F.coalesce(text.rlike(ANY), F.lit(False)))
    # with a line end before it, no text starts with a match, so each part but the first does; starts
    # inside a match are starts as well, for the case that it isn't valid
    rows = rows.withColumn(whole, F.when(F.col(hit), F.concat(F.lit("\n"), text)))
    rows = rows.withColumn(starts, F.transform(F.split(whole, f"(?={ANY})", -1), lambda p: F.length(p)))
    rows = rows.withColumn(matches, F.regexp_extract_all(whole, F.lit(f"(?=({ANY}))"), F.lit(1)))
    sums = F.aggregate(F.slice(starts, 1, F.size(starts) - 1), F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(1)) + n)))
    rows = rows.withColumn(starts, sums).withColumn(found, _found(F.col(whole), F.col(starts), F.col(matches), subkeys(key)))
    before = lambda i: F.when(i > 0, F.get(made, i - 1)["end"]).otherwise(2)
    parts = F.transform(made, lambda m, i: F.concat(F.substr(F.col(whole), before(i), m["at"] - before(i)), m["new"]))
    joined = F.concat(F.array_join(parts, ""), F.substr(F.col(whole), F.try_element_at(made, F.lit(-1))["end"]))
    places = F.transform(made, lambda m: F.struct(m["kind"].alias("kind"), (m["at"] - 1).alias("at")))
    rows = rows.withColumn("private_places", F.coalesce(places, F.array().cast("array<struct<kind:string,at:int>>")))
    out = {
        text_col: F.when(F.size("private_places") > 0, joined).otherwise(text),
        "n_private": F.size("private_places").cast("long"),
        "private_kinds": F.array_join(F.array_sort(F.array_distinct(F.transform("private_places", lambda m: m["kind"]))), ","),
    }
    return rows.withColumns(out).drop(hit, whole, starts, matches, found)
