"""Format-preserving pseudonyms for private numbers and dates.

A value is found by its format, validated and permuted within that format by a keyed Feistel network: the two parts
of a number are changed in turn by a keyed hash of the other. The same value gets the same pseudonym in every
document, different values get different ones, and whoever has the key can turn them back.

Formats: payment card numbers of 16 digits (Luhn; the issuer's first digit and the spacing stay, the check digit is computed
again), dates (a real day from 1900 to 2099 as yyyy-mm-dd, yyyy/mm/dd or dd.mm.yyyy; stay in that range),
telephone numbers of the North American plan (the country and exchange codes' first digits stay in range),
social security numbers, IPv4 addresses, and the local part of e-mail addresses (letters and digits keep their
kind). Values that don't validate, cards of other lengths and telephone numbers of other plans are left as they are.
Whoever knows the key can undo it, so it comes from the caller. Everything is native Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesieve.llm.common import unused

ROUNDS = 8
#: Fixed formats. The order is that of precedence where two could start at the same place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}",
    "card": r"(?<![\w.-])[3-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w-])",
    "date": r"(?<![\w.-])(?:(?:19|20)\d\d([-/])(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.(?:19|20)\d\d)(?![\w-])",
    "phone": r"(?<![\w-])(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?![\w-])",
    "ssn": r"(?<![\w.-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])",
    "ipv4": r"(?<![\w.-])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w-]|\.\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# the back-references of the second pattern with groups follow the first's in the joined expression
assert ANY.count(r"\1") == 2 and ANY.count(r"\2") == 1
#: The 73,049 days from 1900-01-01 to 2099-12-31, as a product.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def _noise(key: str, tag: str, turn: Column, half: Column, size: int) -> Column:
    """A keyed hash of one half, below ``size``."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % size


def feistel(number: Column, sizes: tuple[int, int], key: str, tag: str, back: bool = False) -> Column:
    """Permute the whole numbers below ``sizes[0] * sizes[1]`` by ROUNDS keyed rounds; ``back`` undoes it."""
    a, b = sizes
    low = F.pmod(number, F.lit(b)).cast("bigint")
    start = F.struct(((number - low) / b).cast("bigint").alias("l"), low.alias("r"))

    def turn(at: Column, k: Column) -> Column:
        left, right = at["l"], at["r"]
        sign = -1 if back else 1
        even = F.struct(F.pmod(left + sign * _noise(key, tag, k, right, a), F.lit(a)).cast("bigint").alias("l"), right.alias("r"))
        odd = F.struct(left.alias("l"), F.pmod(right + sign * _noise(key, tag, k, left, b), F.lit(b)).cast("bigint").alias("r"))
        return F.when(k % 2 == 0, even).otherwise(odd)

    order = range(ROUNDS)[::-1] if back else range(ROUNDS)
    return F.aggregate(F.array(*map(F.lit, order)), start, turn, lambda at: at["l"] * b + at["r"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _relaid(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced by ``digits`` in turn; everything else stays in place."""
    chars = F.split(value, "")
    return F.aggregate(
        chars,
        F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda at, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(at["s"], F.substring(digits, at["k"], F.lit(1))).alias("s"), (at["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(at["s"], c).alias("s"), at["k"].alias("k"))),
        lambda at: at["s"],
    )


def _luhn_sum(digits: Column, double_from: int) -> Column:
    """Sum of digits for the Luhn test; those at even places counted from ``double_from`` are doubled."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, k, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((F.length(digits) - k + double_from) % 2 == 0, d).otherwise(twice)

    return F.aggregate(places, F.lit(0), add)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, 0) % 10 == 0


def _pad(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _card(value: Column, key: str, back: bool) -> Column:
    d = _digits(value)
    body = _pad(feistel(F.substring(d, 2, 14).cast("bigint"), (10**7, 10**7), key, "card", back), 14)
    payload = F.concat(F.substring(d, 1, 1), body)
    check = F.pmod(10 - _luhn_sum(payload, 1) % 10, F.lit(10))
    return F.when(luhn_valid(d), _relaid(value, F.concat(payload, check.cast("string")))).otherwise(value)


def _date(value: Column, key: str, back: bool) -> Column:
    iso = value.rlike(r"^\d{4}")
    day = F.when(iso, F.try_to_timestamp(F.translate(value, "/", "-"), F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(value, F.lit("dd.MM.yyyy"))).cast("date")
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("bigint")
    other = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(n, DAYS, key, "date", back).cast("int"))
    text = F.when(iso, F.date_format(other, "yyyyMMdd")).otherwise(F.date_format(other, "ddMMyyyy"))
    return F.when(day.isNotNull() & (n < DAYS[0] * DAYS[1]), _relaid(value, text)).otherwise(value)


def _phone(value: Column, key: str, back: bool) -> Column:
    d = _digits(value)
    own = F.substring(d, -10, 10)
    # area and exchange codes start with 2 to 9: 8 * 10^2 each, then 10^4
    area, exchange, line = (F.substring(own, at, n).cast("bigint") for at, n in ((1, 3), (4, 3), (7, 4)))
    number = (area - 200) * 8_000_000 + (exchange - 200) * 10_000 + line
    out = feistel(number, (800, 8_000_000), key, "phone", back)
    new = F.concat(_pad(F.floor(out / 8_000_000) + 200, 3), _pad(F.floor(out / 10_000) % 800 + 200, 3), _pad(out % 10_000, 4))
    return _relaid(value, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), new))


def _ssn(value: Column, key: str, back: bool) -> Column:
    # areas 001 to 899 without 666: 898; groups 99; serials 9999
    d = _digits(value)
    area, group, serial = (F.substring(d, at, n).cast("bigint") for at, n in ((1, 3), (4, 2), (6, 4)))
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    out = feistel(number, (898, 99 * 9999), key, "ssn", back)
    a = F.floor(out / (99 * 9999)) + 1
    new = F.concat(_pad(a + F.when(a >= 666, 1).otherwise(0), 3), _pad(F.floor(out / 9999) % 99 + 1, 2), _pad(out % 9999 + 1, 4))
    return _relaid(value, new)


def _ipv4(value: Column, key: str, back: bool) -> Column:
    number = F.aggregate(F.split(value, r"\."), F.lit(0).cast("bigint"), lambda n, x: n * 256 + x.cast("bigint"))
    out = feistel(number, (65536, 65536), key, "ipv4", back)
    return F.concat_ws(".", *((F.shiftright(out, s) % 256).cast("string") for s in (24, 16, 8, 0)))


def _email(value: Column, key: str, back: bool) -> Column:
    """Letters and digits of the local part, each shifted within its kind by a keyed hash of the other half."""
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    cut = F.ceil(F.length(local) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), cut).alias("l"), F.substring(local, cut + 1, F.length(local)).alias("r"))
    sign = -1 if back else 1

    def shifted(half: Column, other: Column, k: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit("email"), k.cast("string"), F.length(half).cast("string"), other)

        def one(c: Column, at: Column) -> Column:
            noise = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, at.cast("string")), 256), 1, 15), 16, 10).cast("bigint")
            code = F.ascii(c)
            move = lambda low, n: F.chr(F.pmod(code - low + sign * (noise % n), F.lit(n)) + low)
            return F.when(c.rlike("^[a-z]$"), move(97, 26)).when(c.rlike("^[A-Z]$"), move(65, 26)).when(c.rlike("^[0-9]$"), move(48, 10)).otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def turn(at: Column, k: Column) -> Column:
        even = F.struct(shifted(at["l"], at["r"], k).alias("l"), at["r"].alias("r"))
        odd = F.struct(at["l"].alias("l"), shifted(at["r"], at["l"], k).alias("r"))
        return F.when(k % 2 == 0, even).otherwise(odd)

    order = range(ROUNDS)[::-1] if back else range(ROUNDS)
    return F.concat(F.aggregate(F.array(*map(F.lit, order)), start, turn, lambda at: F.concat(at["l"], at["r"])), F.lit("@"), host)


_BY_KIND = {"email": _email, "card": _card, "date": _date, "phone": _phone, "ssn": _ssn, "ipv4": _ipv4}


def kind_of(value: Column) -> Column:
    """Name of the format of a found value; null if it doesn't validate."""
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(r"^\d{4}[-/]\d\d[-/]\d\d$|^\d\d\.\d\d\.\d{4}$"), "date")
        .when(value.rlike(r"^\d{3}-\d\d-\d{4}$"), "ssn")
        .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ipv4")
        .when(F.length(_digits(value)) == 16, "card")
        .otherwise("phone")
    )


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one found value (or with ``back`` the value of a pseudonym)."""
    kind = kind_of(value)
    out = value
    for name, f in _BY_KIND.items():
        out = F.when(kind == name, f(value, key, back)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with every valid value in the whole ``text`` replaced by its pseudonym, and n_found, n_replaced.

    Null texts stay null with counts of zero; all other columns are kept. A value that is permuted to itself counts
    as not replaced. Existing columns of the names of the counts are replaced. An empty table gives no rows.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    put_aside, in_turn = unused("found", docs), unused("other", docs)
    found = F.when(F.col(text).rlike(r"\d|@"), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
    between = F.split(F.col(text), ANY, -1)
    out = docs.withColumns({put_aside: F.coalesce(found, F.array().cast("array<string>"))})
    out = out.withColumn(in_turn, F.transform(put_aside, lambda v: pseudonym(v, key, back)))
    put = F.array_join(F.zip_with(between, in_turn, lambda gap, v: F.concat(gap, F.coalesce(v, F.lit("")))), "")
    changed = F.aggregate(F.zip_with(put_aside, in_turn, lambda a, b: (a != b).cast("int")), F.lit(0), lambda n, x: n + x)
    return out.withColumns({text: F.when(F.array_size(put_aside) > 0, put).otherwise(F.col(text)), "n_found": F.array_size(put_aside), "n_replaced": changed}).drop(put_aside, in_turn)
