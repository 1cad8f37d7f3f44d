"""Verdicts on what a tool received, as Column functions. Null means: not measured."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import persons, text


def normalised(produced: Column, canonical: Column, pivot: int) -> Column:
    """Whether the value arrived repaired: nothing of it lost, though written otherwise.

    Two persons are compared as persons, two dates as dates; then numbers by their digits, and last the
    words of the canonical value must appear in order.
    """
    words = text.is_subsequence(text.fold_tokens(canonical), text.fold_tokens(produced))
    dates = F.struct(text.as_date(produced, pivot).alias("a"), text.as_date(canonical, pivot).alias("b"))
    rest = text.let(dates, lambda d: F.when(d["a"].isNotNull() & d["b"].isNotNull(), d["a"] == d["b"]).when(text.same_number_repaired(produced, canonical), True).otherwise(words))
    people = persons.looks_like_person(produced) & persons.looks_like_person(canonical)
    return F.when(F.coalesce(produced, F.lit("")) == "", False).when(people, persons.same_person(produced, canonical)).otherwise(rest)


def round_trip(tool_param: Column, call_made: Column, shared: Column, received: Column, owed: Column) -> Column:
    """Null without a parameter or call, or where the substitute is not this span's alone; a missing argument is false."""
    measured = tool_param.isNotNull() & call_made & ~shared
    return F.when(measured, F.coalesce(text.same_delivered(received, owed), F.lit(False)))


def repaired(verdict: Column, received: Column, owed: Column, pivot: int) -> Column:
    return F.coalesce(F.when(~verdict & received.isNotNull(), normalised(received, owed, pivot)), F.lit(False))


def parts_verdict(parts: Column, got: Column, owed: Column, pivot: int) -> Column:
    """struct(round_trip, normalised) over names of parts: each owed part must arrive, an empty one must arrive empty.

    got, owed: maps from names to values. Repaired counts only where all parts arrived.
    """

    def at(m: Column, k: Column) -> Column:
        return F.try_element_at(m, k)

    def want(k: Column) -> Column:
        return F.coalesce(at(owed, k), F.lit(""))

    present = F.forall(parts, lambda k: at(got, k).isNotNull())
    empty = F.forall(F.filter(parts, lambda k: want(k) == ""), lambda k: F.trim(F.coalesce(at(got, k), F.lit(""))) == "")
    owing = F.filter(parts, lambda k: want(k) != "")
    exact = F.forall(owing, lambda k: F.coalesce(text.same_delivered(at(got, k), want(k)), F.lit(False)))
    loose = F.forall(owing, lambda k: F.coalesce(text.same_delivered(at(got, k), want(k)) | normalised(at(got, k), want(k), pivot), F.lit(False)))
    seen = F.struct((present & empty).alias("whole"), exact.alias("exact"))
    return text.let(seen, lambda x: F.struct((x["whole"] & x["exact"]).alias("round_trip"), (x["whole"] & ~x["exact"] & loose).alias("normalised")))


def same_substitute(left: Column, right: Column) -> Column:
    """One substitute, perhaps inflected: equal but for case and spaces, or the same person."""

    def flat(c: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))

    people = persons.looks_like_person(left) & persons.looks_like_person(right)
    return (flat(left) == flat(right)) | (people & persons.same_person(left, right))


def consistency(first_altered: Column, second_altered: Column, first: Column, second: Column) -> Column:
    """Null if neither mention was altered; else whether both were, with one substitute."""
    return F.when(first_altered | second_altered, first_altered & second_altered & same_substitute(first, second))
