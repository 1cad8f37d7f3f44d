"""Text comparison as Column functions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that only format a number; look-alike letters, and letters that stand in for digits.
SEPARATORS = " -()+.,\u00a0\t"
LATIN_TWINS = ("aeopcyx", "аеорсух")
DIGIT_TWINS = ("оОoOзЗб", "0000336")
PIECE = r"\p{L}{3,}|\p{Nd}{3,}"


def let(value: Column, body) -> Column:
    """body(value), with value computed once: as a plain expression it would be repeated at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def norm(c: Column) -> Column:
    """Case, the letter yo and runs of white space folded. (Unicode composition is not touched.)"""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "ё", "е"), r"(?U)\s+", " "))


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{Nd}]", "")


def is_number_like(c: Column) -> Column:
    """Digits and separators only, at least one digit."""
    return F.translate(c, SEPARATORS, "").rlike(r"^\p{Nd}+$")


def _both_numbers(a: Column, b: Column) -> Column:
    return is_number_like(a) & is_number_like(b)


def same_shown(produced: Column, value: Column) -> Column:
    """Whether what is shown still is the value: equal but for norm(), or a number of six digits or more with all its digits."""
    d = digits_of(value)
    return (norm(produced) == norm(value)) | ((F.length(d) >= 6) & _both_numbers(produced, value) & (digits_of(produced) == d))


def same_delivered(produced: Column, canonical: Column) -> Column:
    """Whether the tool got the value: as same_shown(), but of ten digits or more the last ten decide."""
    got, want = digits_of(produced), digits_of(canonical)
    equal = F.when(F.length(want) >= 10, F.right(got, F.lit(10)) == F.right(want, F.lit(10))).otherwise(got == want)
    return (norm(produced) == norm(canonical)) | ((F.length(want) >= 6) & _both_numbers(produced, canonical) & (got != "") & equal)


def pieces(c: Column) -> Column:
    """Runs of three letters or more, or three digits or more, in normal form."""
    return F.regexp_extract_all(norm(c), F.lit(f"({PIECE})"), F.lit(1))


def surviving_pieces(value: Column, substitute: Column) -> Column:
    folded = norm(substitute)
    return F.filter(pieces(value), lambda p: F.contains(folded, p))


def fold_tokens(c: Column) -> Column:
    """Words and digit runs, look-alike letters folded; letters for digits only in tokens that are half digits."""
    tokens = F.filter(F.split(F.translate(norm(c), *LATIN_TWINS), r"(?U)[^\w]+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.when((F.length(digits_of(t)) > 0) & (2 * F.length(digits_of(t)) >= F.length(t)), F.translate(t, *DIGIT_TWINS)).otherwise(t))


def is_subsequence(wanted: Column, got: Column) -> Column:
    """Whether the elements of wanted appear in got in this order; false for an empty wanted."""
    found = F.aggregate(got, F.lit(1), lambda at, g: F.when(F.try_element_at(wanted, at) == g, at + 1).otherwise(at))
    return (F.size(wanted) > 0) & (found > F.size(wanted))


_MONTHS = ("январ", "феврал", "март", "апрел", "ма", "июн", "июл", "август", "сентябр", "октябр", "ноябр", "декабр")


def month_number(word: Column) -> Column:
    """1 to 12 by the stem of a Russian month in any case, else null; the first that fits, as "март" before "ма"."""
    out = F.lit(None).cast("int")
    for n in reversed(range(12)):
        out = F.when(F.startswith(word, F.lit(_MONTHS[n])), n + 1).otherwise(out)
    return out


def as_date(c: Column, pivot: int) -> Column:
    """A real date as struct(day, month, year), else null: d.m.y, y-m-d (a first number over 31), or day, month's name, year.

    Years under 100 are in this century up to pivot (the current year's last two digits), else in the last one.
    """
    numeric, worded = r"^(\p{Nd}{1,4})[./ -](\p{Nd}{1,2})[./ -](\p{Nd}{1,4})$", r"(?U)^(\p{Nd}{1,2})\s+([а-я]+)\s+(\p{Nd}{2,4})$"

    def part(t: Column, pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))

    def by_number(t: Column) -> Column:
        def order(x: Column) -> Column:
            late = x["a"] > 31
            return _dated(F.when(late, x["c"]).otherwise(x["a"]), x["b"], F.when(late, x["a"]).otherwise(x["c"]))

        return let(F.struct(*[part(t, numeric, i).cast("int").alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))]), order)

    def by_word(t: Column) -> Column:
        return _dated(part(t, worded, 1).cast("int"), let(part(t, worded, 2), month_number), part(t, worded, 3).cast("int"))

    def _dated(day: Column, month: Column, year: Column) -> Column:
        return F.struct(day.alias("day"), month.alias("month"), year.alias("year"))

    def whole(d: Column) -> Column:
        year = d["year"] + F.when(d["year"] >= 100, 0).when(d["year"] <= pivot, 2000).otherwise(1900)
        return _dated(d["day"], d["month"], year)

    def real(d: Column) -> Column:
        known = F.try_to_date(F.format_string("%04d-%02d-%02d", d["year"], d["month"], d["day"]), "yyyy-MM-dd").isNotNull()
        return F.when(known & (d["year"] >= 1) & d["month"].isNotNull(), d)

    bare = F.regexp_replace(norm(c), r"^[ .,]+|[ .,]+$", "")
    parsed = let(bare, lambda t: F.when(t.rlike(numeric), by_number(t)).when(t.rlike(worded), by_word(t)))
    return let(let(parsed, whole), real)


def same_number_repaired(produced: Column, canonical: Column) -> Column:
    """Equal digits once letters that stand in for digits are read as such, where either side is a number."""
    mended = F.translate(canonical, "Оо", "00")
    left, right = digits_of(F.translate(canonical, *DIGIT_TWINS)), digits_of(F.translate(produced, *DIGIT_TWINS))
    return (is_number_like(mended) | is_number_like(produced)) & (left != "") & (left == right)
