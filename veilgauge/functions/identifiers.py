"""Russian identifiers and card numbers: check digits, validation and seeded generation, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Reserve codes of the numbering plan, passport series regions, and check-digit weights.
RESERVE_CODES = ("907", "935", "943", "944", "945", "946", "947", "948", "972", "973", "974", "975", "976")
REGIONS = ("45", "40", "46", "50", "63", "66", "24", "92", "77", "16", "52", "54")
INN_11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def digit_array(c: Column) -> Column:
    """The digits of a digit string."""
    return F.transform(F.split(c, ""), lambda d: d.cast("int"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _weighted(c: Column, weights: tuple[int, ...]) -> Column:
    return _sum(F.zip_with(digit_array(c), F.array(*[F.lit(w) for w in weights]), lambda d, w: d * w))


def luhn_ok(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    return F.call_function("luhn_check", digits)


def luhn_digit(body: Column, size: int) -> Column:
    """The digit that completes a body of size digits."""
    doubled = F.transform(digit_array(body), lambda d, i: F.when((size - i) % 2 == 1, F.floor(2 * d / 10) + F.pmod(2 * d, F.lit(10))).otherwise(d).cast("int"))
    return F.pmod(10 - F.pmod(_sum(doubled), F.lit(10)), F.lit(10))


def snils_check(body: Column) -> Column:
    """The check number of nine digits: weights 9 to 1, modulo 101, 100 as 0."""
    return F.pmod(F.pmod(_weighted(body, tuple(range(9, 0, -1))), F.lit(101)), F.lit(100))


def snils_ok(c: Column) -> Column:
    def check(d: Column) -> Column:
        return (F.length(d) == 11) & F.coalesce(F.substring(d, 10, 2).cast("int") == snils_check(F.substring(d, 1, 9)), F.lit(False))

    return let(F.regexp_replace(c, r"[^0-9]", ""), check)


def inn_digits(body: Column) -> Column:
    """The two check digits of ten digits, as a string."""

    def last(c: Column, weights: tuple[int, ...]) -> Column:
        return F.pmod(F.pmod(_weighted(c, weights), F.lit(11)), F.lit(10)).cast("string")

    return let(body, lambda b: let(last(b, INN_11), lambda x: F.concat(x, last(F.concat(b, x), INN_12))))


def inn_ok(c: Column) -> Column:
    return let(c, lambda x: F.when(x.rlike("^[0-9]{12}$"), F.substring(x, 11, 2) == inn_digits(F.substring(x, 1, 10))).otherwise(F.lit(False)))


# --- seeded draws: stable under any partitioning ------------------------------------


def draw(seed: Column, slot: str, n: int) -> Column:
    """A number under n, from a seed and a slot's name; the same on every engine (leading digits of MD5)."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", seed, F.lit(slot)).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def choose(seed: Column, slot: str, options: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), draw(seed, slot, len(options)) + 1)


def digits(seed: Column, slot: str, n: int) -> Column:
    return F.concat(*[draw(seed, f"{slot}{i}", 10).cast("string") for i in range(n)])


def make_phone(seed: Column) -> Column:
    """Ten national digits with a reserve code."""
    return F.concat(choose(seed, "code", RESERVE_CODES), digits(seed, "phone", 7))


def make_snils(seed: Column) -> Column:
    def write(b: Column) -> Column:
        return F.concat(F.concat_ws("-", F.substring(b, 1, 3), F.substring(b, 4, 3), F.substring(b, 7, 3)), F.lit(" "), F.lpad(snils_check(b).cast("string"), 2, "0"))

    return let(F.concat((draw(seed, "snils0", 9) + 1).cast("string"), digits(seed, "snils", 8)), write)


def make_inn(seed: Column) -> Column:
    return let(F.concat((draw(seed, "inn0", 9) + 1).cast("string"), digits(seed, "inn", 9)), lambda b: F.concat(b, inn_digits(b)))


def make_card(seed: Column) -> Column:
    full = let(F.concat(F.lit("2200"), digits(seed, "card", 11)), lambda b: F.concat(b, luhn_digit(b, 15).cast("string")))
    return let(full, lambda c: F.concat_ws(" ", *[F.substring(c, i, 4) for i in (1, 5, 9, 13)]))


def make_passport(seed: Column) -> Column:
    return F.concat_ws(" ", choose(seed, "region", REGIONS), (draw(seed, "year", 15) + 10).cast("string"), (draw(seed, "number", 900000) + 100000).cast("string"))


def make_birth_date(seed: Column) -> Column:
    """An adult's, as d.m.y of two, two and four digits; days up to 28."""
    return F.format_string("%02d.%02d.%04d", draw(seed, "day", 28) + 1, draw(seed, "month", 12) + 1, draw(seed, "born", 50) + 1955)
