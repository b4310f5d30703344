"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Found values are validated (card numbers by their check digit, addresses by their octets, dates by the
calendar, ...) and then permuted by a keyed Feistel network within the set of valid values of their format: a card stays a
card of the same length and leading digit with a right check digit, a date a date between 1900 and 2099, an
IPv4 address an address.  The permutation depends on the key and the kind of value alone, so equal values
get equal pseudonyms in all documents and different ones different pseudonyms, and who has the key can undo it.
Separators, letter case and everything around a value stay as they are.

Numbers go through a generalised Feistel network on Z_a x Z_b (rounds add a keyed hash of one part to the other,
modulo its size).  Local parts of e-mail addresses, and credentials, go through one that shifts digits and letters within
their classes, by a keyed hash of the other half of the string (every second character).

The plan is one projection: no shuffle, no Python. Texts without a digit, an @ or a credential's name are handed
through without the full search.

Defined results: a null text stays null with 0 found; an empty one stays empty; candidates that don't validate stay as they are; repeated
rows are documents of their own; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
#: What is looked for, in the order of precedence.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "aws": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|token|secret|api_key)(?-i) ?[=:] ?\"?[A-Za-z0-9]{8,}+",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)",
    "date": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])|(?<![\w.])\d{2}\.\d{2}\.\d{4}(?!\w)|(?<![\w/])\d{2}/\d{2}/\d{4}(?![\w/])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "nanp": r"(?<![\w+])(?:\+?1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+-])(?:\+?1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}(?:[ .-]\(?\d{2,10}\)?){1,5}(?!\w)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
ANY = "|".join(PATTERNS.values())
HINT = r"[0-9@]|(?i:password|passwd|token|secret|api_key)"
FIRST_DAY, DAYS = "1900-01-01", 73049


def number(text: Column) -> Column:
    """60 bits of the text's SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a*b-1."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def turn(s: Column, i: Column) -> Column:
        f = lambda half: number(F.concat(F.lit(f"{key}|{kind}|"), a.cast("string"), F.lit("|"), b.cast("string"), F.lit("|"), i.cast("string"), F.lit("|"), half.cast("string")))
        return F.when(i % 2 == 1, F.struct(F.pmod(s["l"] + f(s["r"]), a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + f(s["l"]), b).alias("r")))

    start = F.struct(((value - F.pmod(value, b)) / b).cast("long").alias("l"), F.pmod(value, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * b + s["r"])


def halves(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the digit strings of this length (2 to 18): both halves are numbers of their own."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    a, b = F.pow(F.lit(10), u).cast("long"), F.pow(F.lit(10), n - u).cast("long")
    return F.lpad(feistel(digits.cast("long"), a, b, key, kind).cast("string"), n, "0")


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def fill(form: Column, digits: Column) -> Column:
    """The form with its digits replaced one by one."""
    at = lambda i: F.length(only_digits(F.substr(form, F.lit(1), i)))
    one = lambda i: F.when(F.substr(form, i, F.lit(1)).between("0", "9"), F.substr(digits, at(i), F.lit(1))).otherwise(F.substr(form, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")


def luhn(digits: Column, check: bool) -> Column:
    """Sum of the digits with every second one doubled, from the right: with a check digit at the end, or as if one was to follow."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        double = F.pmod(n - i, F.lit(2)) == (1 if check else 0)
        return s + F.when(double, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def card(s: Column, key: str) -> Column:
    d = only_digits(s)
    n = F.length(d)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), halves(F.substr(d, F.lit(2), n - 2), key, "card"))
    full = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn(b, False), F.lit(10)), F.lit(10)).cast("string")))
    valid = d.rlike("^[2-6]") & (F.pmod(luhn(d, True), F.lit(10)) == 0)
    return F.when(valid, F.get(F.transform(full, lambda x: fill(s, x)), F.lit(0)))


def split_numbers(s: Column, by: str) -> Column:
    return F.transform(F.split(s, by), lambda x: x.cast("long"))


def ip(s: Column, key: str) -> Column:
    o = split_numbers(s, r"\.")
    value = F.aggregate(o, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    new = feistel(value, 65536, 65536, key, "ip")
    text = F.transform(F.array(new), lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, k), F.lit(256)).cast("string") for k in (24, 16, 8, 0)]))
    return F.when(F.forall(o, lambda x: x < 256), F.get(text, F.lit(0)))


def date(s: Column, key: str) -> Column:
    form = F.when(s.rlike("-"), F.lit("yyyy-MM-dd")).when(s.rlike(r"\."), F.lit("dd.MM.yyyy")).otherwise(F.lit("MM/dd/yyyy"))
    iso = F.when(s.rlike("-"), s).when(s.rlike(r"\."), F.concat(F.substr(s, F.lit(7), F.lit(4)), F.lit("-"), F.substr(s, F.lit(4), F.lit(2)), F.lit("-"), F.substr(s, F.lit(1), F.lit(2)))).otherwise(F.concat(F.substr(s, F.lit(7), F.lit(4)), F.lit("-"), F.substr(s, F.lit(1), F.lit(2)), F.lit("-"), F.substr(s, F.lit(4), F.lit(2))))
    day = F.date_diff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
    new = F.transform(F.array(day), lambda v: F.when(v.between(0, DAYS - 1), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(v, 17, 4297, key, "date").cast("int")), "yyyy-MM-dd")))
    parts = lambda x: F.when(form == "yyyy-MM-dd", x).when(form == "dd.MM.yyyy", F.concat(F.substr(x, F.lit(9), F.lit(2)), F.lit("."), F.substr(x, F.lit(6), F.lit(2)), F.lit("."), F.substr(x, F.lit(1), F.lit(4)))).otherwise(F.concat(F.substr(x, F.lit(6), F.lit(2)), F.lit("/"), F.substr(x, F.lit(9), F.lit(2)), F.lit("/"), F.substr(x, F.lit(1), F.lit(4))))
    return F.get(F.transform(new, parts), F.lit(0))


def ssn(s: Column, key: str) -> Column:
    p = split_numbers(s, "-")
    area, group, serial = (F.get(p, F.lit(i)) for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    new = F.transform(F.array(feistel(index * 9999 + serial - 1, 88902, 9999, key, "ssn")), lambda v: F.struct(((v - F.pmod(v, F.lit(9999))) / 9999).cast("long").alias("x"), (F.pmod(v, F.lit(9999)) + 1).alias("serial")))
    new = F.transform(new, lambda v: F.struct(((v["x"] - F.pmod(v["x"], F.lit(99))) / 99 + 1).cast("long").alias("area"), (F.pmod(v["x"], F.lit(99)) + 1).alias("group"), v["serial"].alias("serial")))
    return F.when(valid, F.get(F.transform(new, lambda v: F.concat_ws("-", F.lpad((v["area"] + F.when(v["area"] > 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad(v["group"].cast("string"), 2, "0"), F.lpad(v["serial"].cast("string"), 4, "0"))), F.lit(0)))


def nanp(s: Column, key: str) -> Column:
    """North American numbers: area and exchange don't begin with 0 or 1."""
    d = only_digits(s)
    own = F.right(d, F.lit(10))
    area, exchange, line = (F.substr(own, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (4, 3), (7, 4)))
    value = ((area - 200) * 800 + exchange - 200) * 10000 + line
    new = F.transform(F.array(feistel(value, 80000, 80000, key, "phone")), lambda v: F.concat(F.substr(d, F.lit(1), F.length(d) - 10), (F.floor(v / 8_000_000) + 200).cast("string"), (F.pmod(F.floor(v / 10_000), F.lit(800)) + 200).cast("string"), F.lpad(F.pmod(v, F.lit(10_000)).cast("string"), 4, "0")))
    return F.when((area >= 200) & (exchange >= 200), F.get(F.transform(new, lambda x: fill(s, x)), F.lit(0)))


def phone(s: Column, key: str) -> Column:
    """International numbers: the country code stays."""
    code = F.regexp_extract(s, r"^\+\d{1,3}", 0)
    rest = F.substr(s, F.length(code) + 1)
    d = only_digits(rest)
    new = F.transform(F.array(halves(d, key, "phone")), lambda x: F.concat(code, fill(rest, x)))
    return F.when(F.length(d).between(6, 14), F.get(new, F.lit(0)))


def shifted(s: Column, key: str, kind: str) -> Column:
    """A keyed permutation of strings that keeps what is a digit, a small or a capital letter, or anything else."""

    def turn(s: Column, r: Column) -> Column:
        chars = F.sequence(F.lit(1), F.length(s))
        other = F.array_join(F.transform(F.filter(chars, lambda i: F.pmod(i + r, F.lit(2)) == 1), lambda i: F.substr(s, i, F.lit(1))), "")
        keyed = F.sha2(F.concat(F.lit(f"{key}|{kind}|"), F.length(s).cast("string"), F.lit("|"), r.cast("string"), F.lit("|"), other).cast("binary"), 256)

        def one(i: Column, stream: Column) -> Column:
            c = F.substr(s, i, F.lit(1))
            by = F.conv(F.substr(stream, F.pmod(i, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            moved = F.ascii(c)
            for low, n in ((48, 10), (65, 26), (97, 26)):
                moved = F.when(F.ascii(c).between(low, low + n - 1), F.pmod(F.ascii(c) - low + by, F.lit(n)) + low).otherwise(moved)
            return F.when(F.pmod(i + r, F.lit(2)) == 1, c).when(c.rlike("^[0-9A-Za-z]$"), F.char(moved)).otherwise(c)

        return F.get(F.transform(F.array(keyed), lambda stream: F.array_join(F.transform(chars, lambda i: one(i, stream)), "")), F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), s, turn)


def email(s: Column, key: str) -> Column:
    return F.concat(shifted(F.substring_index(s, "@", 1), key, "email"), F.lit("@"), F.substring_index(s, "@", -1))


def aws(s: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), shifted(F.substr(s, F.lit(5)), key, "aws"))


def secret(s: Column, key: str) -> Column:
    head = F.regexp_extract(s, r"^(?i:password|passwd|token|secret|api_key)(?-i) ?[=:] ?\"?", 0)
    return F.concat(head, shifted(F.substr(s, F.length(head) + 1), key, "secret"))


KINDS: dict[str, Callable[[Column, str], Column]] = {"email": email, "aws": aws, "secret": secret, "ip": ip, "date": date, "ssn": ssn, "nanp": nanp, "phone": phone, "card": card}


def pseudonym(s: Column, key: str) -> Column:
    """The pseudonym of a found value, or null if it doesn't validate as any kind that its form fits."""
    whole = lambda k: s.rlike("^(?:" + PATTERNS[k] + ")$")
    return F.coalesce(*[F.when(whole(k), f(s, key)) for k, f in KINDS.items()])


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str = "n_found") -> DataFrame:
    """docs with personal data in the text column replaced, and one more column: how many values were.

    Who has the key can undo the pseudonyms, so there is none by default; an empty one is refused."""
    if not key:
        raise ValueError("pseudonyms need a key")
    own = fresh("_pairs", docs)
    c = F.col(text)
    found = F.regexp_extract_all(c, F.lit(ANY), F.lit(0))
    pairs = F.transform(found, lambda s: F.struct(s.alias("old"), pseudonym(s, key).alias("new")))
    rows = docs.withColumn(own, F.when(c.rlike(HINT), pairs))
    gaps = F.split(c, ANY, -1)
    put = F.transform(F.col(own), lambda x, i: F.concat(F.coalesce(x["new"], x["old"]), F.get(gaps, i + 1)))
    changed = F.when(F.size(own) > 0, F.concat(F.get(gaps, F.lit(0)), F.array_join(put, ""))).otherwise(c)
    n = F.coalesce(F.size(F.filter(own, lambda x: x["new"].isNotNull())), F.lit(0))
    return rows.withColumns({count: F.when(F.col(own).isNull(), 0).otherwise(n), text: changed}).drop(own)
