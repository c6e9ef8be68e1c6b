"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted within their format by a keyed Feistel network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm._native import let

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_YEAR, _MONTH, _DAY = r"(?:19|20)[0-9]{2}", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12][0-9]|3[01])"
#: The length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
#: What may be personal, by kind; the first kind that matches at a place has it. Whether it is valid is looked at after.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBANS})(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9\-])",
    "date": rf"(?<![A-Za-z0-9./\-])(?:{_YEAR}-{_MONTH}-{_DAY}|{_YEAR}/{_MONTH}/{_DAY}|{_YEAR}\.{_MONTH}\.{_DAY}|{_DAY}\.{_MONTH}\.{_YEAR}|{_DAY}/{_DAY}/{_YEAR}|{_DAY}-{_DAY}-{_YEAR})(?=T[0-9]{{2}}:|[^A-Za-z0-9/\-]|$)",
    "ip": rf"(?<![A-Za-z0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![A-Za-z0-9])",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Country calling codes, none of which begins another; those not listed have three digits.
CALLING_CODES = r"^(?:1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98|[0-9]{3})"
#: 1900-01-01 to 2099-12-31 are 73049 = 17 * 4297 days.
_FIRST_DAY, _DAYS = "1900-01-01", (17, 4297)
#: Times a date is permuted again at most, to find one on the same side of the 12th; two of five days are up to it.
_WALK = 64


def feistel(values: Column, radices: Column, key: str, tag: str, rounds: int = ROUNDS) -> Column:
    """A permutation of the arrays whose i-th value is below the i-th radix, by key and tag.

    The left and the right half take turns: each value of one is moved, modulo its radix, by a keyed SHA-256 of the
    other half, the round and its place. Such a round can be undone, so different arrays stay different.
    """

    def turn(v: Column, r: Column) -> Column:
        half = F.floor(F.size(v) / 2).cast("int")
        left = r % 2 == 0
        other = F.array_join(F.when(left, F.slice(v, half + 1, F.size(v) - half)).otherwise(F.slice(v, F.lit(1), half)).cast("array<string>"), ",")

        def moved(said: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                radix = F.element_at(radices, i + 1)
                by = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), r.cast("string"), i.cast("string"), F.size(v).cast("string"), said), 256), 1, 12), 16, 10).cast("long")
                return F.when((i < half) == left, ((x + by) % radix).cast("int")).otherwise(x)

            return F.transform(v, one)

        return let(other, moved)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), values.cast("array<int>"), turn)


def permuted(text: Column, movable: Column, key: str, tag: str) -> Column:
    """The text with its letters and digits permuted, each a letter (of the same case) or digit again, at places (from 0) that are movable(array<boolean>)."""

    def change(chars: Column, ok: Column) -> Column:
        digit, letter = lambda c: c.rlike("[0-9]"), lambda c: c.rlike("[A-Za-z]")
        free = F.filter(F.sequence(F.lit(1), F.size(chars)), lambda i: F.element_at(ok, i) & F.element_at(chars, i).rlike("[A-Za-z0-9]"))

        def write(at: Column) -> Column:
            picked = F.transform(at, lambda i: F.element_at(chars, i))
            value = F.transform(picked, lambda c: F.ascii(F.lower(c)) - F.when(digit(c), 48).otherwise(97))
            radix = F.transform(picked, lambda c: F.when(digit(c), 10).otherwise(26))

            def put(new: Column) -> Column:
                def one(c: Column, i: Column) -> Column:
                    place = F.array_position(at, (i + 1).cast("int"))
                    base = F.when(digit(c), 48).when(c.rlike("[a-z]"), 97).otherwise(65)
                    return F.when(place > 0, F.char(F.try_element_at(new, place.cast("int")) + base)).otherwise(c)

                return F.array_join(F.transform(chars, one), "")

            return F.when(F.size(at) > 0, let(feistel(value, radix, key, tag), put)).otherwise(text)

        return let(free, write)

    return let(F.split(text, ""), lambda chars: let(movable, lambda ok: change(chars, ok)))


def _from(text: Column, first: Column) -> Column:
    """Movable are the places from `first` on."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: i > first)


def luhn_sum(digits: Column) -> Column:
    """Of digits of which the last stands for a check digit: 0 modulo 10 if that is right."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda a, i: a + let(F.substring(digits, i, F.lit(1)).cast("int") * F.when((F.length(digits) - i) % 2 == 1, 2).otherwise(1), lambda x: x - F.when(x > 9, 9).otherwise(0)),
    ) % 10


def mod97(text: Column) -> Column:
    """Of an IBAN without spaces: its first four characters go to the end, letters count 10 to 35."""
    turned = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)) % 97)


def _card(m: Column, key: str) -> Column:
    plain = lambda c: F.regexp_replace(c, "[^0-9]", "")
    body = permuted(F.substring(m, F.lit(1), F.length(m) - 1), _from(F.substring(m, F.lit(1), F.length(m) - 1), F.lit(1)), key, "card")
    new = let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(plain(b), F.lit("0")))) % 10).cast("string")))
    return F.when(luhn_sum(plain(m)) == 0, new).otherwise(m)


def _iban(m: Column, key: str) -> Column:
    plain = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    body = permuted(F.substring(m, F.lit(5), F.length(m)), _from(F.substring(m, F.lit(5), F.length(m)), F.lit(0)), key, "iban")
    check = lambda b: F.lpad((98 - mod97(F.concat(F.substring(m, 1, 2), F.lit("00"), plain(b)))).cast("string"), 2, "0")
    return F.when(mod97(plain(m)) == 1, let(body, lambda b: F.concat(F.substring(m, 1, 2), check(b), b))).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    part = F.split(m, "-").cast("array<int>")

    def new(p: Column) -> Column:
        area, group, serial = p[0], p[1], p[2]
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        value = F.array(area - F.when(area < 666, 1).otherwise(2), group - 1, serial - 1)
        write = lambda v: F.format_string("%03d-%02d-%04d", v[0] + F.when(v[0] < 665, 1).otherwise(2), v[1] + 1, v[2] + 1)
        return F.when(valid, let(feistel(value, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn"), write)).otherwise(m)

    return let(part, new)


def _ip(m: Column, key: str) -> Column:
    return F.array_join(feistel(F.split(m, r"\.").cast("array<int>"), F.array(*[F.lit(256)] * 4), key, "ip").cast("array<string>"), ".")


def _joined(sep: Column, *parts: Column) -> Column:
    return F.concat(parts[0], sep, parts[1], sep, parts[2])


def _date(m: Column, key: str) -> Column:
    """Day numbers are permuted, the same for all ways of writing a date. A day that its month lacks is left.

    With slashes or hyphens and the year last, the month comes first if the first number can be one; if it can't, the
    day does. For the pseudonym to read the same way, days up to the 12th become such days and later days later ones:
    the permutation is repeated until the day is on its side.
    """
    part = F.split(m, r"[./\-]").cast("array<int>")
    sep = F.regexp_extract(m, r"[./\-]", 0)
    year_first, dotted = m.rlike(r"^[0-9]{4}"), m.contains(".")

    def of(p: Column) -> Column:
        day_first = ~year_first & (dotted | (p[0] > 12))
        y, mo = F.when(year_first, p[0]).otherwise(p[2]), F.when(year_first | day_first, p[1]).otherwise(p[0])
        d = F.when(year_first, p[2]).when(day_first, p[0]).otherwise(p[1])
        month = F.when(mo <= 12, F.make_date(y, F.least(mo, F.lit(12)), F.lit(1)))
        n = F.datediff(F.date_add(month, d - 1), F.lit(_FIRST_DAY).cast("date"))
        value = F.array(F.floor(n / _DAYS[1]).cast("int"), n % _DAYS[1])
        day = lambda v: F.date_add(F.lit(_FIRST_DAY).cast("date"), v[0] * _DAYS[1] + v[1])
        once = lambda v: feistel(v, F.array(*[F.lit(x) for x in _DAYS]), key, "date")
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), once(value), lambda v, _: F.when((F.dayofmonth(day(v)) > 12) == (d > 12), v).otherwise(once(v)))

        def write(t: Column) -> Column:
            two, four = lambda x: F.lpad(x.cast("string"), 2, "0"), F.year(t).cast("string")
            return F.when(year_first, _joined(sep, four, two(F.month(t)), two(F.dayofmonth(t)))).when(day_first, _joined(sep, two(F.dayofmonth(t)), two(F.month(t)), four)).otherwise(_joined(sep, two(F.month(t)), two(F.dayofmonth(t)), four))

        return F.when(d <= F.dayofmonth(F.last_day(month)), let(day(walked), write)).otherwise(m)

    return let(part, of)


def _phone(m: Column, key: str) -> Column:
    """The digits after the country code are permuted, however they are set apart, so all spellings of a number agree; one without a code counts as those digits alone."""
    bare = F.regexp_replace(m, "[^0-9]", "")

    def of(digits: Column) -> Column:
        code = F.when(m.startswith("+"), F.length(F.regexp_extract(digits, CALLING_CODES, 0))).otherwise(0)
        movable = lambda c: F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i), "[^0-9]", "")) > c)
        return F.when(F.length(digits).between(8, 15), let(code, lambda c: permuted(m, movable(c), key, "phone"))).otherwise(m)

    return let(bare, of)


def _email(m: Column, key: str) -> Column:
    """Local part and domain are permuted, the top-level domain stays."""
    kept = F.length(F.regexp_extract(m, r"\.[A-Za-z]+$", 0))
    return permuted(m, F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: i <= F.length(m) - kept), key, "email")


def pseudonym(m: Column, key: str) -> Column:
    """What stands for one match of PATTERN."""
    whole = lambda kind: m.rlike(f"^(?:{KINDS[kind]})$")
    make = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "date": _date, "ip": _ip, "phone": _phone}
    out = F.when(whole("email"), _email(m, key))
    for kind in list(KINDS)[1:]:
        out = out.when(whole(kind), make[kind](m, key))
    return out.otherwise(m)


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the text's personal data replaced by pseudonyms, and n_replaced (long), the number of replaced places.

    The key is a secret: who has it can undo the permutations. It stands in the plans, so keep event logs and plans as
    safe as the key, or set spark.redaction.string.regex. An empty key is refused.

    E-mail addresses, IBANs (of their country's length, check digits right), card numbers (Luhn digit right), US social security numbers (in the
    issued ranges), IPv4 addresses, telephone numbers (8 to 15 digits) and dates of 1900 to 2099 (days that exist, in time stamps too)
    each become one of the same format that is valid again: check digits are made anew, separators, case, country codes
    and top-level domains stay. Equal values get equal pseudonyms in all documents, whatever separators, order of day and
    month or letter case they are written with (a telephone number with or without its country code, too), and
    different ones of a format different ones. Dates up to the 12th of a month stay so, and later ones late.
    Numbers that don't validate are left alone. Null stays null (n_replaced 0), texts without personal data stay as
    they are; an n_replaced column of the input is replaced. Rows are changed in place, without a shuffle.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    t = F.col(text)

    def rewritten(found: Column) -> Column:
        def join(new: Column) -> Column:
            pieces = F.zip_with(F.split(t, PATTERN, -1), new, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
            return F.struct(F.array_join(pieces, "").alias("text"), F.size(F.filter(F.arrays_zip(found.alias("a"), new.alias("b")), lambda p: p["a"] != p["b"])).cast("long").alias("n"))

        return let(F.transform(found, lambda m: pseudonym(m, key)), join)

    plain = F.struct(t.alias("text"), F.lit(0).cast("long").alias("n"))
    new = F.when(t.rlike("[0-9@]"), let(F.regexp_extract_all(t, F.lit(PATTERN), 0), lambda found: F.when(F.size(found) > 0, rewritten(found)).otherwise(plain))).otherwise(plain)
    held = next(f"__new{k}" for k in range(len(docs.columns) + 1) if f"__new{k}" not in docs.columns)  # a name that the input lacks
    return docs.select(*[f"`{c}`" for c in docs.columns if c != "n_replaced"], new.alias(held)).withColumns({text: F.col(f"{held}.text"), "n_replaced": F.col(f"{held}.n")}).drop(held)
