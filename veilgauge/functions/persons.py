"""Names of persons: shape, inflection and comparison.

No morphological dictionary is at hand, so that lemmas come from suffix rules for regular Russian
paradigms: a word's candidates are all nominatives from which a rule could have made it. That knows
fewer words than a dictionary; candidates of unlike words seldom meet.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, norm

WORD = r"[А-Яа-яЁё]+(?:-[А-Яа-яЁё]+)?"
#: (ending of an oblique form, ending of the nominative)
RULES = (
    ("ого", "ий"), ("ому", "ий"), ("им", "ий"), ("ой", "ая"), ("ую", "ая"), ("ой", "а"), ("ою", "а"),
    ("ова", "ов"), ("ову", "ов"), ("овым", "ов"), ("ове", "ов"), ("ева", "ев"), ("еву", "ев"), ("евым", "ев"), ("еве", "ев"),
    ("ина", "ин"), ("ину", "ин"), ("иным", "ин"), ("ине", "ин"), ("ына", "ын"), ("ыну", "ын"), ("ыным", "ын"),
    ("а", ""), ("у", ""), ("ом", ""), ("е", ""), ("я", "й"), ("ю", "й"), ("ем", "й"), ("я", "ь"), ("ю", "ь"), ("ем", "ь"),
    ("ы", "а"), ("и", "а"), ("у", "а"), ("е", "а"), ("и", "я"), ("ю", "я"), ("е", "я"), ("ей", "я"),
)


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def looks_like_person(c: Column) -> Column:
    """One to four Cyrillic words and nothing else."""
    t = F.trim(c)
    return t.rlike(r"(?U)^[А-Яа-яЁё\s-]+$") & F.size(words_of(t)).between(1, 4)


def lemmas(word: Column) -> Column:
    """The word itself and its possible nominatives, folded."""
    rules = F.array(*[F.struct(F.lit(end).alias("end"), F.lit(base).alias("base")) for end, base in RULES])

    def made(w: Column) -> Column:
        fits = F.filter(rules, lambda r: F.endswith(w, r["end"]) & (F.length(w) > F.length(r["end"]) + 2))
        return F.array_distinct(F.concat(F.array(w), F.transform(fits, lambda r: F.concat(F.substring(w, F.lit(1), F.length(w) - F.length(r["end"])), r["base"]))))

    return let(norm(word), made)


def same_person(left: Column, right: Column) -> Column:
    """As many words, each paired with an unused one that shares a lemma, whatever the order; pairs are taken greedily."""
    none = F.array().cast("array<int>")

    def compare(x: Column) -> Column:
        def pair(used: Column, own: Column) -> Column:
            free = F.filter(F.transform(x["b"], lambda r, i: F.struct(i.alias("i"), r.alias("r"))), lambda y: ~F.array_contains(used, y["i"]) & F.arrays_overlap(y["r"], own))
            return F.concat(used, F.transform(F.slice(free, 1, 1), lambda y: y["i"]))

        return (F.size(x["a"]) > 0) & (F.size(x["a"]) == F.size(x["b"])) & (F.size(F.aggregate(x["a"], none, pair)) == F.size(x["a"]))

    return let(F.struct(F.transform(words_of(left), lemmas).alias("a"), F.transform(words_of(right), lemmas).alias("b")), compare)
