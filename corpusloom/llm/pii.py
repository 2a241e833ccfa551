"""Format-preserving pseudonyms for validated numbers, dates and e-mail names, with DataFrame functions alone.

A Feistel network over mixed radices permutes each kind's whole domain under a key: a pair (l, r)
with l below A and r below B becomes another such pair, and different pairs stay different. So a
value always gets the same pseudonym, in every document and whatever separators it is written
with, and no table of values is kept or shuffled: each row is rewritten where it lies. The round
function is HMAC-SHA-256 under the key.

Kinds (checked before they are permuted, and valid afterwards):

- date: yyyy-mm-dd, dd/mm/yyyy, dd.mm.yyyy, dd-mm-yyyy (or month first), a day of 1800 to 2199;
- card: 13 to 19 digits with a right Luhn digit, which is computed anew;
- iban: right modulo 97; the country and letters stay, digits are permuted, check digits computed anew;
- ssn: ddd-dd-dddd with a valid area, group and serial;
- ip: four octets; phone: a number with a country code, or in the (ddd) ddd-dddd or ddd-ddd-dddd form;
- email: the letters and the digits before the @, each kind in its places.

Defined results: anything that fails its check is left as it is; a null text stays null and an empty
one empty, without values; repeated rows and equal values are rewritten alike; where two kinds could
fit, the first of this list that passes its check wins; an empty table gives an empty one. Other
columns, whatever their names, are unchanged: if ``found`` is taken, underscores are added to it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key for tests and examples alone: who knows the key can undo the pseudonyms.
EXAMPLE_KEY = "example key"
ROUNDS = 8

# The forms of each kind.
_FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "date": r"(?:1[89]|2[01])\d\d-\d\d-\d\d|\d\d[/.-]\d\d[/.-](?:1[89]|2[01])\d\d",
    "iban": r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "phone": r"\+\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}(?:[ .-]\d{2,8}){2,4}|\+\d{8,15}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "ip": r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}",
    "card": r"\d(?:[ -]?\d){12,18}",
}
_BEFORE, _AFTER = r"(?<![A-Za-z0-9+])(?<![0-9][.@-])", r"(?![A-Za-z0-9]|[.@-][0-9])"
#: The forms but for cards; after a date as yyyy-mm-dd a time may follow.
_OTHER = _BEFORE + r"(?:(?:1[89]|2[01])\d\d-\d\d-\d\d(?=[Tt]\d)|(?:" + "|".join(f"(?:{x})" for k, x in _FORMS.items() if k != "card") + ")" + _AFTER + ")"
#: Digits, spaces and hyphens, in which cards are looked for. It leaves the first part of dd/mm/yyyy.
_RUN = r"\d[\d -]{11,}\d"
_ANY = "(?:" + _OTHER + "|" + _BEFORE + _RUN + _AFTER + r"(?!(?<=[ -]\d{1,2})/\d))"
#: Groups in which cards are written. They are looked for at each group of a run, any other at its start.
_GROUPS = (r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}\1\d{3}", r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}", r"\d{4}([ -])\d{6}\1\d{4,5}", r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,3}", r"\d{13,19}")
_LOOSE = tuple(r"\d(?:[ -]?\d){%d}" % n for n in range(18, 11, -1))
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BASE26 = "0123456789abcdefghijklmnop"


def _number(s: Column) -> Column:
    return F.coalesce(s.try_cast("long"), F.lit(0).cast("long"))


def _power(base: int, n: Column) -> Column:
    """base ** n as a whole number, n at most 17."""
    return F.element_at(F.array(*(F.lit(min(base**i, (1 << 63) - 1)) for i in range(18))), n.cast("int") + 1)


def _keyed(message: Column, key: str) -> Column:
    """HMAC-SHA-256 (RFC 2104) of a string, in hexadecimal."""
    k = key.encode()
    k = (k if len(k) <= 64 else hashlib.sha256(k).digest()).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytearray(c ^ 0x36 for c in k)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(c ^ 0x5C for c in k)), F.unhex(inner)), 256)


def feistel(left: Column, right: Column, a: Column, b: Column, kind: str, key: str) -> Column:
    """Permutes pairs (l, r), l < a, r < b: a struct of both. In turn each side shifts by a keyed digest of the other."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(x: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, x["r"]).otherwise(x["l"])
        digest = _keyed(F.concat_ws("|", F.lit(kind), i.cast("string"), a.cast("string"), b.cast("string"), other.cast("string")), key)
        shift = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(even, (x["l"] + shift % a) % a).otherwise(x["l"]).cast("long").alias("l"), F.when(even, x["r"]).otherwise((x["r"] + shift % b) % b).cast("long").alias("r")
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _pad(n: Column, size: Column) -> Column:
    """As many digits as ``size`` says (none for 0)."""
    return F.when(size > 0, F.lpad(n.cast("string"), size.cast("int"), F.lit("0"))).otherwise(F.lit(""))


def _digits(d: Column, kind: str, key: str) -> Column:
    """Permutes a string of up to 34 digits among those of its length."""
    n = F.length(d)
    h = F.floor(n / 2).cast("int")
    got = feistel(_number(d.substr(F.lit(1), h)), _number(d.substr(h + 1, n - h)), _power(10, h), _power(10, n - h), kind, key)
    return F.transform(F.array(got), lambda x: F.concat(_pad(x["l"], h), _pad(x["r"], n - h)))[0]


def _only(s: Column, keep: str) -> Column:
    return F.regexp_replace(s, f"[^{keep}]", "")


def _refill(form: Column, chars: Column, kind: str) -> Column:
    """``form`` with its characters of ``kind`` replaced by ``chars``, in order."""

    def one(i: Column) -> Column:
        c = form.substr(i, F.lit(1))
        return F.when(c.rlike(f"^[{kind}]$"), chars.substr(F.length(_only(form.substr(F.lit(1), i), kind)), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")


def _luhn(d: Column) -> Column:
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = d.substr(i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _card(s: Column, key: str) -> Column:
    d = _only(s, "0-9")

    def rest(body: Column) -> Column:
        return F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))

    new = _let(_digits(d.substr(F.lit(1), F.length(d) - 1), "card", key), rest)
    return F.when(_luhn(d) == 0, _let(new, lambda x: _refill(s, x, "0-9")))


def _mod97(s: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        c = s.substr(i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _iban(s: Column, key: str) -> Column:
    plain = F.regexp_replace(s, " ", "")

    def swap(x: Column) -> Column:
        country, check, body = x.substr(F.lit(1), F.lit(2)), x.substr(F.lit(3), F.lit(2)), x.substr(F.lit(5), F.length(x))
        permuted = _let(_digits(_only(body, "0-9"), "iban", key), lambda d: _refill(body, d, "0-9"))
        new = _let(permuted, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when((F.length(x) >= 15) & (F.length(x) <= 34) & (_mod97(F.concat(body, country, check)) == 1), _let(new, lambda n: _refill(s, n, "A-Z0-9")))

    return _let(plain, swap)


def _ssn(s: Column, key: str) -> Column:
    area, group, serial = (s.substr(F.lit(a), F.lit(n)).try_cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    l, r = area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1

    def write(x: Column) -> Column:
        new = x["l"] + F.when(x["l"] >= 665, 2).otherwise(1)
        return F.concat(F.lpad(new.cast("string"), 3, "0"), F.lit("-"), F.lpad((F.floor(x["r"] / 9999) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((x["r"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(ok, _let(feistel(l, r, F.lit(898), F.lit(99 * 9999), "ssn", key), write))


def _ip(s: Column, key: str) -> Column:
    o = F.transform(F.split(s, r"\."), lambda x: x.try_cast("long"))

    def write(x: Column) -> Column:
        return F.concat_ws(".", *(c.cast("string") for c in (F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256)))

    return _let(o, lambda v: _let(feistel(v[0] * 256 + v[1], v[2] * 256 + v[3], F.lit(65536), F.lit(65536), "ip", key), write))


def _phone(s: Column, key: str) -> Column:
    """The country code stays: what stands before a separator after +, else all but ten digits."""
    d = _only(s, "0-9")
    code = F.when(s.rlike(r"^\+\d{1,3}[ (.-]"), F.length(F.regexp_extract(s, r"^\+(\d+)", 1))).otherwise(F.greatest(F.length(d) - 10, F.lit(0)))
    new = F.concat(d.substr(F.lit(1), code), _digits(d.substr(code + 1, F.length(d)), "phone", key))
    return F.when((F.length(d) >= 7) & (F.length(d) <= 15), _let(new, lambda x: _refill(s, x, "0-9")))


def _date(s: Column, key: str) -> Column:
    iso = F.try_to_date(s, "yyyy-MM-dd")
    mark = s.substr(F.lit(3), F.lit(1))
    flat = F.when(s.rlike(r"^\d\d[/.-]"), F.translate(s, "/.", "--"))
    day_first, month_first = F.try_to_date(flat, "dd-MM-yyyy"), F.try_to_date(flat, "MM-dd-yyyy")
    value = F.when(flat.isNull(), iso).otherwise(F.coalesce(day_first, month_first))
    days = F.datediff(value, F.lit("1800-01-01").cast("date"))

    def write(x: Column) -> Column:
        new = F.date_add(F.lit("1800-01-01").cast("date"), (x["l"] * 773 + x["r"]).cast("int"))
        shape = F.when(day_first.isNotNull(), F.date_format(new, "dd-MM-yyyy")).otherwise(F.date_format(new, "MM-dd-yyyy"))
        return F.when(flat.isNull(), F.date_format(new, "yyyy-MM-dd")).otherwise(F.regexp_replace(shape, F.lit("-"), mark))

    return F.when(value.isNotNull(), _let(feistel(F.floor(days / 773), days % 773, F.lit(189), F.lit(773), "date", key), write))


def _pieces(s: Column, size: int, then) -> Column:
    """``then`` of each ``size`` characters in turn, joined; empty for an empty string."""
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(s) - 1) / size), F.lit(0)).cast("int"))
    return F.array_join(F.transform(starts, lambda i: then(s.substr(i * size + 1, F.lit(size)))), "")


def _alphabet(part: Column, kind: str, key: str) -> Column:
    """Permutes up to 24 letters among those of their number, as numbers in base 26."""
    n = F.length(part)
    h = F.floor(n / 2).cast("int")

    def value(x: Column) -> Column:
        return F.when(F.length(x) > 0, F.conv(F.translate(x, _LETTERS, _BASE26), 26, 10).cast("long")).otherwise(F.lit(0).cast("long"))

    def text(x: Column, size: Column) -> Column:
        return F.when(size > 0, F.translate(F.lpad(F.lower(F.conv(x.cast("string"), 10, 26)), size, F.lit("0")), _BASE26, _LETTERS)).otherwise(F.lit(""))

    got = feistel(value(part.substr(F.lit(1), h)), value(part.substr(h + 1, n - h)), _power(26, h), _power(26, n - h), kind, key)
    return _let(got, lambda x: F.concat(text(x["l"], h), text(x["r"], n - h)))


def _email(s: Column, key: str) -> Column:
    """Upper case becomes lower case. Names of neither letters nor digits stay."""
    name, rest = F.regexp_extract(s, "^([^@]+)(@.+)$", 1), F.regexp_extract(s, "^([^@]+)(@.+)$", 2)
    letters, digits = F.lower(_only(name, "A-Za-z")), _only(name, "0-9")
    new = _let(_pieces(letters, 24, lambda x: _let(x, lambda y: _alphabet(y, "email", key))), lambda x: _refill(name, x, "A-Za-z"))
    new = _let(new, lambda n: _let(_pieces(digits, 34, lambda x: _let(x, lambda y: _digits(y, "email", key))), lambda x: _refill(n, x, "0-9")))
    return F.when(F.length(letters) + F.length(digits) > 0, F.concat(new, rest))


_KINDS = {"email": _email, "date": _date, "iban": _iban, "phone": _phone, "ssn": _ssn, "ip": _ip, "card": _card}


def pseudonym(value: Column, key: str) -> Column:
    """Struct kind, new: of the first kind whose form and check fit, else nulls."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("new"))
    for kind, make in reversed(_KINDS.items()):
        out = F.coalesce(F.when(value.rlike(f"^(?:{_FORMS[kind]})$"), _wrap(kind, make(value, key))), out)
    return out


def _wrap(kind: str, new: Column) -> Column:
    return _let(new, lambda x: F.when(x.isNotNull(), F.struct(F.lit(kind).alias("kind"), x.alias("new"))))


def _piece(s: Column, value: bool) -> Column:
    return F.struct(s.alias("s"), F.lit(value).alias("value"))


def _between(s: Column) -> Column:
    """What lies between cards, as array of struct s, value: dates, numbers and the like, and the rest."""
    both = F.zip_with(F.split(s, _OTHER, -1), F.regexp_extract_all(s, F.lit(_OTHER), F.lit(0)), lambda gap, x: F.array(_piece(gap, False), _piece(F.coalesce(x, F.lit("")), True)))
    return F.flatten(both)


def _cut(run: Column) -> Column:
    """A run of digits as array of struct s, value: its cards from left to right, and what lies between."""

    def card(at: Column) -> Column:
        rest = run.substr(at, F.lit(38))
        fresh = (at == 1) | run.substr(F.greatest(at - 2, F.lit(1)), F.lit(2)).rlike("^[ -]{2}$")
        tries = [F.regexp_extract(rest, f"^(?:{x})(?![0-9])", 0) for x in _GROUPS] + [F.when(fresh, F.regexp_extract(rest, f"^(?:{x})(?![0-9])", 0)) for x in _LOOSE]
        good = F.filter(F.array(*tries), lambda c: F.when(c != "", _luhn(_only(c, "0-9")) == 0))
        return F.struct(at.alias("at"), F.get(good, F.lit(0)).alias("s"))

    begins = F.filter(F.sequence(F.lit(1), F.length(run)), lambda i: (i == 1) | run.substr(F.greatest(i - 1, F.lit(1)), F.lit(2)).rlike("^[ -][0-9]$"))
    cards = F.filter(F.transform(begins, card), lambda c: c["s"].isNotNull())

    def add(x: Column, c: Column) -> Column:
        both = F.concat(x["parts"], F.array(_piece(run.substr(x["to"], c["at"] - x["to"]), False), _piece(c["s"], True)))
        return F.when(c["at"] < x["to"], x).otherwise(F.struct((c["at"] + F.length(c["s"])).alias("to"), both.alias("parts")))

    start = F.struct(F.lit(1).alias("to"), F.expr("cast(array() as array<struct<s:string,value:boolean>>)").alias("parts"))
    parts = F.aggregate(cards, start, add, lambda x: F.concat(x["parts"], F.array(_piece(run.substr(x["to"], F.length(run)), False))))
    return F.flatten(F.transform(parts, lambda p: F.when(p["value"], F.array(p)).otherwise(_between(p["s"]))))


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``text_col`` rewritten under ``key``, and ``found``: array of struct kind, new."""
    name = "found"
    while name in df.columns:
        name += "_"
    t = F.col("row")[text_col]
    # one column holds the rest: no other name can clash
    one = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"))
    one = one.withColumn("old", F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(_ANY), F.lit(0))))
    one = one.withColumn("gap", F.when(F.size("old") > 0, F.split(t, _ANY, -1)))
    cut = F.transform("old", lambda x: F.when(x.rlike(f"^{_RUN}$"), _cut(x)).otherwise(F.array(_piece(x, True))))
    none = F.expr("cast(array() as array<struct<s:string,value:boolean>>)")
    one = one.withColumn("old", F.flatten(F.zip_with("gap", cut, lambda gap, x: F.concat(F.array(_piece(gap, False)), F.coalesce(x, none)))))
    one = one.withColumn("new", F.transform("old", lambda x: F.when(x["value"], pseudonym(x["s"], key))))
    text = F.coalesce(F.array_join(F.zip_with("old", "new", lambda old, new: F.coalesce(new["new"], old["s"])), ""), t)
    found = F.filter(F.coalesce("new", F.expr("cast(array() as array<struct<kind:string,new:string>>)")), lambda x: x["new"].isNotNull())
    return one.select(*((text if c == text_col else F.col("row")[c]).alias(c) for c in df.columns), found.alias(name))
