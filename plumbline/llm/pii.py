"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in SQL functions.

Numbers with a rule of their own are validated by it (card: Luhn, IBAN: mod 97,
IPv4: octets, SSN: area, group and serial, dates: the calendar) and permuted
within their format, so that a pseudonym passes the same rule and equal values
get equal pseudonyms in every document.  Phone numbers, mail names and access
keys are permuted the same way, each character within its class.  Separators,
mail domains, country codes and key prefixes stay, and so does the name before a
secret value ("token = ...").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

ROUNDS = 8
#: Re-encryptions until a value falls into its format again.  At least 0.88 of all values are in it, so the chance to need
#: more is under 1e-29; that is an error, never a value out of format.
WALKS = 32
FIRST_DAY, DAYS = "1900-01-01", 73_049
DAY_RADIX = (271, 270)

#: A value ends where no letter or digit follows; a date also before the time of an ISO time stamp.
_EDGE, _END = r"(?<![A-Za-z0-9_.@+\-])", r"(?:(?![A-Za-z0-9_])|(?<=[0-9]{4}-[0-9]{2}-[0-9]{2})(?=T[0-9]{2}:?[0-9]{2}))"
#: Length of an IBAN without country and check digits, and the countries that have it.
IBAN_LENGTHS = {
    11: "NO", 12: "BE", 14: "DK|FI|FK|FO|GL|NL|SD", 15: "MK|SI", 16: "AT|BA|EE|KZ|LT|LU|MN|XK", 17: "CH|HR|LI|LV", 18: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 19: "AE|GI|IL|IQ|OM|SO|TL",
    20: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 21: "LY|PT|ST", 22: "IS|TR", 23: "BI|DJ|FR|GR|IT|MC|MR|SM", 24: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV", 25: "BR|EG|PS|QA|UA", 26: "JO|KW|MU|YE", 27: "MT|SC", 28: "LC", 29: "RU",
}
_IBAN_OF_COUNTRY = "(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(f"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}" for n, c in IBAN_LENGTHS.items()) + ")" + _END
#: The shapes, in the order in which they are tried.
SHAPES = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.)+[A-Za-z]{2,24}",
    "iban": rf"(?:{_IBAN_OF_COUNTRY}|" r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)",
    "key": r"AKIA[A-Z0-9]{16}",
    "secret": r"(?i:token|secret|password|passwd|api[_\-]?key|access[_\-]?key) ?[=:] ?[\"']?[A-Za-z0-9_\-]{16,128}",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:(?:\+?1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}|\+[0-9](?:[ .\-]?[0-9]){7,14}|\+[0-9]{1,3}[ .\-][0-9]{1,4}(?:[ .\-][0-9]{2,4}){1,4})",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "card": r"[0-9](?:[ \-]?[0-9]){12,18}",
}
PATTERN = _EDGE + "(?:" + "|".join(SHAPES.values()) + ")" + _END


def _number(hexes: Column, at: Column | int, digits: int) -> Column:
    return F.conv(F.substring(hexes, at, F.lit(digits)) if isinstance(at, Column) else F.substring(hexes, at, digits), 16, 10).cast("long")


def _shifted(c: Column, by: Column) -> Column:
    """A character moved within its class: digits, lower case, upper case, 2-9 written as U+00C0 on, hexadecimal digits as U+00D0 on."""
    code = F.ascii(c)
    move = lambda first, n: F.char(F.lit(first) + F.pmod(code - first + by, F.lit(n)))
    return F.when(code.between(48, 57), move(48, 10)).when(code.between(97, 122), move(97, 26)).when(code.between(65, 90), move(65, 26)).when(code.between(192, 199), move(192, 8)).when(code.between(208, 223), move(208, 16)).otherwise(c)


def _moved(half: Column, other: Column, tweak: Column) -> Column:
    """``half`` with every character moved by keyed numbers drawn from ``other``."""
    seed = F.concat(tweak, other)
    hexes = F.concat(F.sha2(F.concat(seed, F.lit("|0")), 256), F.sha2(F.concat(seed, F.lit("|1")), 256))
    each = lambda h: F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), lambda i: _shifted(F.substring(half, i, F.lit(1)), _number(h, F.pmod(i - 1, F.lit(32)) * 4 + 1, 4))), "")
    return F.when(F.length(half) == 0, half).otherwise(let(hexes, each))


def feistel(core: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """A permutation of the strings that have the character classes of ``core``."""
    half = (F.length(core) / 2).cast("int")
    start = F.struct(F.substring(core, F.lit(1), half).alias("a"), F.substring(core, half + 1, F.length(core)).alias("b"))

    def turn(x: Column, r: Column) -> Column:
        tweak = F.concat(F.lit(f"{key}|{kind}|"), r.cast("string"), F.lit("|"))
        even = F.struct(_moved(x["a"], x["b"], tweak).alias("a"), x["b"].alias("b"))
        return F.when(r % 2 == 0, even).otherwise(F.struct(x["a"].alias("a"), _moved(x["b"], x["a"], tweak).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda x: F.concat(x["a"], x["b"]))


def _feistel_numbers(a: Column, b: Column, radix: tuple[int, int], key: str, kind: str) -> Column:
    """A permutation of pairs of numbers below the two radices, as a struct (a, b)."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(x: Column, r: Column) -> Column:
        draw = lambda other: _number(F.sha2(F.concat(F.lit(f"{key}|{kind}|"), r.cast("string"), F.lit("|"), other.cast("string")), 256), 1, 12)
        even = F.struct(F.pmod(x["a"] + draw(x["b"]), F.lit(radix[0])).alias("a"), x["b"].alias("b"))
        return F.when(r % 2 == 0, even).otherwise(F.struct(x["a"].alias("a"), F.pmod(x["b"] + draw(x["a"]), F.lit(radix[1])).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _walk(value: Column, step, fits) -> Column:
    """``step`` until ``fits``: a permutation of the values that fit; an error where ``WALKS`` steps do not reach one."""
    lost = lambda x: F.raise_error(F.lit(f"no value of the format within {WALKS} steps"))
    return F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), step(value), lambda x, _: F.when(fits(x), x).otherwise(step(x)), lambda x: F.when(fits(x), x).otherwise(lost(x)))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _alnum(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]", "")


def refill(shape: Column, core: Column) -> Column:
    """``shape`` with its letters and digits replaced in order by those of ``core``."""
    at = lambda i: F.substring(shape, i, F.lit(1))
    nth = lambda i: F.length(_alnum(F.substring(shape, F.lit(1), i)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(at(i).rlike("[A-Za-z0-9]"), F.substring(core, nth(i), F.lit(1))).otherwise(at(i))), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum with the last digit as check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def mod97(text: Column) -> Column:
    """Remainder of the digits of ``text``, with A = 10 to Z = 35, by 97."""

    def add(left: Column, i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (left * 10 + F.ascii(c) - 48) % 97).otherwise((left * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    body = lambda d: let(feistel(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"), lambda x: F.concat(x, F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))
    return let(_digits(m), lambda d: F.when(luhn_sum(d) % 10 == 0, refill(m, body(d))).otherwise(m))


def _iban(m: Column, key: str) -> Column:
    def fresh(c: Column) -> Column:
        land = F.substring(c, 1, 2)
        return let(feistel(F.substring(c, F.lit(5), F.length(c)), key, "iban"), lambda x: F.concat(land, F.lpad((98 - mod97(F.concat(x, land, F.lit("00")))).cast("string"), 2, "0"), x))

    return let(_alnum(m), lambda c: F.when((F.length(c) >= 15) & (mod97(F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))) == 1), refill(m, fresh(c))).otherwise(m))


def _ssn_valid(d: Column) -> Column:
    return ~d.rlike("^(?:000|666|9)|^[0-9]{3}00|0000$")


def _ssn(m: Column, key: str) -> Column:
    return let(_digits(m), lambda d: F.when(_ssn_valid(d), refill(m, _walk(d, lambda x: feistel(x, key, "ssn"), _ssn_valid))).otherwise(m))


def _phone(m: Column, key: str) -> Column:
    """The last ten digits; area and exchange codes that start with 2 to 9 still do."""
    high = lambda c: F.translate(c, "23456789", "".join(map(chr, range(192, 200))))
    low = lambda c: F.translate(c, "".join(map(chr, range(192, 200))), "23456789")
    part = lambda d, a, n: F.substring(d, a, n)
    marked = lambda d: F.concat(high(part(d, 1, 1)), part(d, 2, 2), high(part(d, 4, 1)), part(d, 5, 6))
    return let(_digits(m), lambda d: let(F.right(d, F.lit(10)), lambda ten: refill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), low(feistel(marked(ten), key, "phone"))))))


def _ip(m: Column, key: str) -> Column:
    def fresh(o: Column) -> Column:
        x = _feistel_numbers(o[0] * 256 + o[1], o[2] * 256 + o[3], (1 << 16, 1 << 16), key, "ip")
        return let(x, lambda y: F.concat_ws(".", *((F.floor(y[h] / 256) if n == 0 else y[h] % 256).cast("string") for h in "ab" for n in (0, 1))))

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), lambda o: F.when(F.forall(o, lambda x: x <= 255), fresh(o)).otherwise(m))


def _date(m: Column, key: str) -> Column:
    """The day's number from 1900 to 2099, permuted; slashes are read month first unless that is no date."""
    padded = m.rlike("^[0-9]{2}/[0-9]{2}/")
    trials = [("yyyy-MM-dd", m.contains("-")), ("dd.MM.yyyy", m.contains(".")), ("MM/dd/yyyy", padded), ("dd/MM/yyyy", padded), ("M/d/yyyy", m.contains("/") & ~padded), ("d/M/yyyy", m.contains("/") & ~padded)]
    day = lambda fmt: F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(fmt))), F.lit(FIRST_DAY))
    step = lambda n: let(_feistel_numbers(F.floor(n / DAY_RADIX[1]), n % DAY_RADIX[1], DAY_RADIX, key, "date"), lambda x: x["a"] * DAY_RADIX[1] + x["b"])

    def written(fmt: str):
        return lambda n: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), _walk(n.cast("long"), step, lambda x: x < DAYS).cast("int")), fmt)

    out = m
    for fmt, fits in reversed(trials):
        out = F.when(fits & day(fmt).between(0, DAYS - 1), let(day(fmt), written(fmt))).otherwise(out)
    return out


def _email(m: Column, key: str) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(refill(name, feistel(_alnum(name), key, "email")), F.substring(m, F.length(name) + 1, F.length(m)))


def _key(m: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), feistel(F.substring(m, 5, 16), key, "key"))


def _secret(m: Column, key: str) -> Column:
    """The value after its name; hexadecimal digits stay such, in one case."""
    head = F.regexp_extract(m, r"^[A-Za-z_\-]+ ?[=:] ?[\"']?", 0)
    digits, marks = "0123456789abcdef", "".join(map(chr, range(208, 224)))

    def fresh(core: Column) -> Column:
        hexed = F.translate(feistel(F.translate(F.lower(core), digits, marks), key, "secret"), marks, digits)
        return F.when(core.rlike("^[0-9a-f]+$"), hexed).when(core.rlike("^[0-9A-F]+$"), F.upper(hexed)).otherwise(feistel(core, key, "secret"))

    value = lambda h: F.substring(m, F.length(h) + 1, F.length(m))
    return let(head, lambda h: F.concat(h, refill(value(h), let(_alnum(value(h)), fresh))))


KINDS = {"email": _email, "iban": _iban, "key": _key, "secret": _secret, "date": _date, "ssn": _ssn, "phone": _phone, "ip": _ip, "card": _card}


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found string, by the first shape it has; itself where validation fails."""
    out = m
    for kind in reversed(SHAPES):
        out = F.when(m.rlike(f"^(?:{SHAPES[kind]})$"), KINDS[kind](m, key)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_private``, the number of replaced strings.

    A null text stays null and an empty one empty, with 0; a text of any length
    is searched whole; rows that repeat get the same pseudonyms; other columns
    pass unread, whatever their names (a column ``n_private`` is replaced).  One
    narrow pass, all in SQL functions.
    """
    own = F.struct(*(F.col(c) for c in docs.columns if c != "n_private"))
    rows = docs.select(own.alias("_row"), F.col(text).alias("_text"))
    some = F.col("_text").rlike("[0-9@]") | F.col("_text").contains("AKIA")
    found = F.when(some, F.regexp_extract_all("_text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def swapped(f: Column) -> Column:
        parts = lambda x: F.flatten(F.zip_with(F.split("_text", PATTERN, -1), x, lambda a, b: F.array(a, F.coalesce(b, F.lit("")))))
        n = lambda x: F.size(F.filter(F.zip_with(f, x, lambda a, b: a != b), lambda y: y)).cast("long")
        return let(F.transform(f, lambda m: pseudonym(m, key)), lambda x: F.struct(F.array_join(parts(x), "").alias("text"), n(x).alias("n")))

    done = let(found, lambda f: F.when(F.size(f) > 0, swapped(f)))
    rows = rows.select("_row", "_text", done.alias("_done"))
    row = F.col("_row").withField(text, F.coalesce("_done.text", "_text"))
    return rows.select(row.alias("_row"), F.coalesce("_done.n", F.lit(0).cast("long")).alias("_n")).select("_row.*", F.col("_n").alias("n_private"))
