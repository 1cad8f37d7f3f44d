"""Detection of identifiers by ordered patterns, masking by placeholders, and restoration; all in-row expressions.

A detector is a list of (type, pattern), the most specific first. Its matches are claimed greedily, pattern by
pattern and from left to right; a match that overlaps a claimed one is dropped. No row leaves its task.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The shapes of the types, in order of priority.
RUSSIAN = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("CARD", r"\b(?:\d{4}[ -]?){3}\d{4}\b"),
    ("SNILS", r"\b\d{3}-\d{3}-\d{3} ?\d{2}\b"),
    ("PHONE", r"(?:\+7|\b8)[\s\-()]*\d{3}[\s\-()]*\d{3}[\s\-]*\d{2}[\s\-]*\d{2}\b"),
    ("INN", r"\b\d{12}\b"),
    ("PASSPORT", r"\b\d{2} ?\d{2} ?\d{6}\b"),
    ("DOB", r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b"),
    ("NAME", r"\b[А-ЯЁ][а-яё]{2,}(?:\s+[А-ЯЁ][а-яё]{2,}){1,2}\b"),
    (
        "ADDRESS",
        r"(?i)(?:(?:ул|пер|просп|пр-д|наб|б-р|ш|пл|ал|туп)\.\s*|(?:улиц[аы]|переулок|проспект|шоссе|бульвар|набережная|площадь|проезд)\s+)"
        r"[^,.;\n]{2,40}(?:,?\s*(?:д\.?|дом)?\s*\d+[а-я]?)?(?:,?\s*(?:кв\.?|квартира)\s*\d+)?",
    ),
)
#: Shapes of the driver's documents, which hold no Russian text.
FOREIGN = (
    ("SECRET", r"token = \"[0-9a-f]{40}\""),
    ("PHONE", r"\+1 \([0-9]{3}\) 555-[0-9]{4}"),
    ("IP", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"),
)

SPAN = "struct<start: int, end: int, type: string, value: string, rank: int>"
_FOUND = "struct<start: int, end: int, type: string, value: string>"
#: What a text must hold for a pattern to match: dear patterns are not tried on texts that lack it.
_CYRILLIC = "[А-Яа-яЁё]"
GUARDS = {dict(RUSSIAN)["EMAIL"]: "@", dict(RUSSIAN)["NAME"]: _CYRILLIC, dict(RUSSIAN)["ADDRESS"]: _CYRILLIC}


def _java(pattern: str) -> str:
    """Case-insensitive patterns fold Cyrillic letters too."""
    return pattern.replace("(?i)", "(?iu)")


def found(text: Column, kind: str, pattern: str) -> Column:
    """All matches (start, end, type, value). Their offsets follow from the gaps between them, which a split on the pattern gives."""
    p = F.lit(f"({_java(pattern)})")
    values = F.regexp_extract_all(text, p, F.lit(1))
    gaps = F.split(text, _java(pattern), -1)
    seed = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_FOUND}>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("type"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    # most rows have no match: a look is cheaper than the fold
    every = F.when(F.size(values) > 0, F.aggregate(pairs, seed, step, lambda acc: acc["out"]))
    if guard := GUARDS.get(pattern):
        every = F.when(F.contains(text, F.lit(guard)) if len(guard) == 1 else text.rlike(guard), every)
    return F.coalesce(every, F.array().cast(f"array<{_FOUND}>"))


def matches(text: Column, kind: str, pattern: str, rank: int) -> Column:
    """All matches as spans."""
    return _ranked(found(text, kind, pattern), rank)


def holds(text: Column, patterns: tuple) -> Column:
    """Whether any pattern matches, thus whether there are claims at all; a look that makes no spans."""
    looks = [text.rlike(_java(p)) if p not in GUARDS else F.when(F.contains(text, F.lit(GUARDS[p])) if len(GUARDS[p]) == 1 else text.rlike(GUARDS[p]), text.rlike(_java(p))).otherwise(False) for _, p in patterns]
    return reduce(or_, looks)


def _ranked(c: Column, rank: int) -> Column:
    return F.transform(c, lambda m: F.struct(m["start"], m["end"], m["type"], m["value"], F.lit(rank).alias("rank")))


def claimed(candidates: Column) -> Column:
    """Of spans in the order of their patterns those that overlap no earlier claim."""
    none = F.array().cast(f"array<{SPAN}>")

    def claim(taken: Column, m: Column) -> Column:
        free = ~F.exists(taken, lambda t: (m["end"] > t["start"]) & (m["start"] < t["end"]))
        return F.when(free, F.concat(taken, F.array(m))).otherwise(taken)

    return F.aggregate(candidates, none, claim)


def claims(text: Column, patterns: tuple = RUSSIAN) -> Column:
    """The claimed spans in the order of the claims."""
    every = F.concat(*[matches(text, kind, p, rank) for rank, (kind, p) in enumerate(patterns)])
    return F.when(text.isNull(), F.array().cast(f"array<{SPAN}>")).otherwise(claimed(every))


def with_claims(df: DataFrame, text_col: str, **detectors: tuple) -> DataFrame:
    """df with a column of claims for each detector. A pattern that several of them have runs once over a text."""
    text = F.col(f"`{text_col}`")
    unique = dict.fromkeys(p for patterns in detectors.values() for p in patterns)
    names = {p: f"__vg_found_{i}" for i, p in enumerate(unique)}
    out = df.withColumns({n: found(text, *p) for p, n in names.items()})
    none = F.array().cast(f"array<{SPAN}>")
    made = {k: F.when(text.isNull(), none).otherwise(claimed(F.concat(*[_ranked(F.col(names[p]), i) for i, p in enumerate(patterns)]))) for k, patterns in detectors.items()}
    return out.withColumns(made).drop(*names.values())


def spans(claimed: Column) -> Column:
    """Claims from left to right."""
    return F.array_sort(claimed)


TOKEN = "struct<type: string, n: int, token: string, value: string>"


def vault(claimed: Column) -> Column:
    """A placeholder for each distinct value of a row's claims: <TYPE_N>, N counted by type in the order of the claims.

    A value keeps the type that first claimed it.
    """
    none = F.array().cast(f"array<{TOKEN}>")

    def add(known: Column, c: Column) -> Column:
        n = F.size(F.filter(known, lambda k: k["type"] == c["type"])) + 1
        token = F.concat(F.lit("<"), c["type"], F.lit("_"), n.cast("string"), F.lit(">"))
        entry = F.struct(c["type"].alias("type"), n.alias("n"), token.alias("token"), c["value"].alias("value"))
        return F.when(F.exists(known, lambda k: k["value"] == c["value"]), known).otherwise(F.concat(known, F.array(entry)))

    return F.aggregate(claimed, none, add)


def mask_everywhere(text: Column, tokens: Column) -> Column:
    """Each value replaced wherever it stands, outside its span too, in the order of the vault."""
    return F.aggregate(tokens, text, lambda t, k: F.replace(t, k["value"], k["token"]))


def mask_spans(text: Column, left_to_right: Column, tokens: Column) -> Column:
    """Only the spans replaced."""
    seed = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        token = F.try_element_at(F.filter(tokens, lambda k: k["value"] == s["value"]), F.lit(1))["token"]
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.coalesce(token, s["value"])).alias("out"))

    return F.aggregate(left_to_right, seed, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def restore(text: Column, tokens: Column) -> Column:
    """Placeholders replaced by their values, in serialised JSON as anywhere: a quote in a value breaks the JSON on purpose."""
    return F.aggregate(tokens, text, lambda t, k: F.replace(t, k["token"], k["value"]))


def detect(df: DataFrame, text_col: str, patterns: tuple = RUSSIAN) -> DataFrame:
    """df with claims, spans (from left to right) and vault; columns of these names are replaced."""
    out = df.withColumn("claims", claims(F.col(f"`{text_col}`"), patterns))
    return out.withColumns({"spans": spans(F.col("claims")), "vault": vault(F.col("claims"))})


def span_rows(df: DataFrame, *keys: str) -> DataFrame:
    """A row per span."""
    return df.select(*keys, F.explode("spans").alias("s")).select(*keys, "s.*")


def conversation_vault(found: DataFrame, conversation: str, *order: str) -> DataFrame:
    """Placeholders for whole conversations: (conversation, type, n, token, value).

    found: a row per claim, with type, value and the columns of order, by which values are first seen.
    """
    by = [F.col(c) for c in order]
    first = Window.partitionBy(conversation, "value").orderBy(*by)
    seen = found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    n = F.row_number().over(Window.partitionBy(conversation, "type").orderBy(*by))
    out = seen.withColumn("n", n)
    return out.select(conversation, "type", "n", F.concat(F.lit("<"), "type", F.lit("_"), F.col("n").cast("string"), F.lit(">")).alias("token"), "value")


def arguments(c: Column) -> Column:
    """A JSON object as a map of strings, other values as JSON; null where it is none."""
    return F.from_json(c, "map<string,string>")
