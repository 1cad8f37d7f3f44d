"""Pools of names, streets and cities: snapshots read, cleaned, tiered, and merged with precedence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Tiers of popularity buckets, the bucket whose short forms count, and kinds of streets.
BUCKET_TIERS = {"top": "common", "popular": "common", "medium": "common", "rare": "tail"}
SHORT_FORMS_OF = "top"
SHORT_FORM_LETTERS = (3, 5)
STREET_KINDS = ("улица", "переулок", "проспект", "шоссе", "бульвар", "набережная", "площадь", "проезд", "аллея", "тупик")
# Endings of surnames that tell the gender.
FEMALE_ENDINGS = ("ова", "ева", "ёва", "ина", "ына", "ская", "цкая", "ая")
MALE_ENDINGS = ("ов", "ев", "ёв", "ин", "ын", "ский", "цкий", "ой", "ый", "ий")


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """The items of a snapshot, a JSON document with ``items``, as rows."""
    whole = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select(F.explode("items").alias("item")).select("item.*")


def is_clean(label: Column) -> Column:
    """One capitalised Cyrillic word, perhaps of two parts with a hyphen."""
    return label.rlike(r"^[А-ЯЁ][а-яё]+(-[А-ЯЁ][а-яё]+)?$")


def surname_gender(name: Column) -> Column:
    """m or f by the ending, u where it tells nothing."""

    def ends(endings: Sequence[str]) -> Column:
        return name.rlike(f"({'|'.join(endings)})$")

    return F.when(ends(FEMALE_ENDINGS), "f").when(ends(MALE_ENDINGS), "m").otherwise("u")


def split_street(label: Column) -> Column:
    """struct(name, type) of a label with a street kind among its words, the first of them; null if it has none, or if
    what is left is empty, has no letter, or holds more than Cyrillic letters, digits and hyphens."""
    words = F.filter(F.split(F.trim(label), r"\s+"), lambda w: w != "")
    kind = F.try_element_at(F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), F.lower(w).alias("w"))), lambda x: x["w"].isin(*STREET_KINDS)), F.lit(1))
    rest = F.array_join(F.filter(words, lambda _, i: i != kind["i"]), " ")
    good = rest.rlike(r"^[А-ЯЁа-яё0-9 -]+$") & rest.rlike(r"[А-ЯЁа-яё]")
    return F.when(kind.isNotNull() & good, F.struct(rest.alias("name"), kind["w"].alias("type")))


def merge_pools(*pools: DataFrame, key: str) -> DataFrame:
    """The union of pools, of one key's rows that of the earliest pool."""
    every = reduce(DataFrame.unionByName, [p.withColumn("_priority", F.lit(i)) for i, p in enumerate(pools)])
    names = [c for c in every.columns if c != "_priority"]
    w = Window.partitionBy(key).orderBy("_priority", *[c for c in names if c != key])
    return every.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*names)


def largest(pool: DataFrame, by: str, *names: str, n: int | None = None) -> DataFrame:
    """The rows with a positive value, the largest first, ties by names; the first n of them, if given."""
    out = pool.where(F.col(by) > 0).orderBy(F.desc(by), *names)
    return out if n is None else out.limit(n)


def person_tier(given: Column, surname: Column) -> Column:
    """The tier of a person: that of the rarer part, in the order common, diminutive, tail, foreign."""
    order = F.array(*[F.lit(t) for t in ("common", "diminutive", "tail", "foreign")])
    return F.element_at(order, F.greatest(F.array_position(order, given), F.array_position(order, surname)).cast("int"))


def given_names(ranked: DataFrame, other: DataFrame, foreign: DataFrame) -> DataFrame:
    """(name, gender, tier). ranked: name, gender, bucket, short_forms; other, foreign: name, gender.

    Foreign names come before all. Names of the ranked pool have their bucket's tier, short forms of the first bucket are
    diminutives, and names that only the other pool has are tail.
    """
    tiers = F.create_map(*[F.lit(x) for kv in BUCKET_TIERS.items() for x in kv])
    low, high = SHORT_FORM_LETTERS
    own = ranked.where(is_clean(F.col("name"))).select("name", "gender", tiers[F.col("bucket")].alias("tier"))
    short = ranked.where(F.col("bucket") == SHORT_FORMS_OF).select(F.explode("short_forms").alias("name"), "gender", F.lit("diminutive").alias("tier"))
    short = short.where(is_clean(F.col("name")) & F.length("name").between(low, high))
    rest = other.where(is_clean(F.col("name")) & F.col("gender").isin("m", "f")).select("name", "gender", F.lit("tail").alias("tier"))
    return merge_pools(foreign.select("name", "gender", F.lit("foreign").alias("tier")), own, short, rest, key="name")


def surnames(common: DataFrame, other: DataFrame, foreign: DataFrame) -> DataFrame:
    """(name, gender, tier). common: name, gender; other and foreign: name. Foreign surnames serve both genders."""
    own = common.select("name", "gender", F.lit("common").alias("tier"))
    rest = other.where(is_clean(F.col("name"))).select("name", surname_gender(F.col("name")).alias("gender"), F.lit("tail").alias("tier"))
    return merge_pools(foreign.select("name", F.lit("u").alias("gender"), F.lit("foreign").alias("tier")), own, rest, key="name")


@dataclass(frozen=True)
class Pools:
    """What the generator draws from; names by (gender, tier), u is for both genders. Cities are in falling population."""

    given: dict[tuple[str, str], tuple[str, ...]]
    surnames: dict[tuple[str, str], tuple[str, ...]]
    patronymics: dict[str, tuple[str, ...]]
    streets: tuple[tuple[str, str], ...]
    cities: tuple[str, ...]


def collect_pools(given: DataFrame, family: DataFrame, patronymics: DataFrame, streets: DataFrame, cities: DataFrame) -> Pools:
    """Pools at the driver; names are as many as a language has. patronymics: name, gender; streets: name, type; cities: name, population."""

    def grouped(df: DataFrame, *keys: str) -> dict:
        rows = df.groupBy(*keys).agg(F.sort_array(F.collect_set("name")).alias("names")).collect()
        return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: tuple(r["names"]) for r in rows}

    by_population = largest(cities, "population", "name").select("name").collect()
    return Pools(
        grouped(given, "gender", "tier"), grouped(family, "gender", "tier"), grouped(patronymics, "gender"),
        tuple((r["name"], r["type"]) for r in streets.select("name", "type").distinct().orderBy("name", "type").collect()), tuple(r[0] for r in by_population),
    )


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


#: Small pools written for this package, for tests and queries.
SMALL = Pools(
    given={
        ("m", "common"): _words("Иван Сергей Олег Павел Артур Глеб Андрей Никита Игорь Илья"), ("f", "common"): _words("Анна Ольга Мария Дарья Вера Полина Любовь Юлия Алина Нина"),
        ("m", "tail"): _words("Евлампий Савватий Рустэм Тихомир"), ("f", "tail"): _words("Аглая Милица Земфира Пелагея"),
        ("m", "diminutive"): _words("Ваня Серёжа Паша Лёва"), ("f", "diminutive"): _words("Аня Оля Маша Даша"),
        ("m", "foreign"): _words("Пьер Карлос Хендрик Мурат"), ("f", "foreign"): _words("Ингрид Чиара Лейла Юки"),
    },
    surnames={
        ("m", "common"): _words("Рябов Тарасов Лосев Яшин Калинин Вересаев Дубровский Зимин"), ("f", "common"): _words("Рябова Тарасова Лосева Яшина Калинина Вересаева Дубровская Зимина"),
        ("m", "tail"): _words("Беркутов Щепотьев Хрущатый"), ("f", "tail"): _words("Беркутова Щепотьева Хрущатая"), ("u", "tail"): _words("Кочубей Стецюк"),
        ("u", "foreign"): _words("Андерсен Моретти Вонг Дюваль Ортега"),
    },
    patronymics={"m": _words("Иванович Петрович Олегович Андреевич"), "f": _words("Ивановна Петровна Олеговна Андреевна")},
    streets=(("Садовая", "улица"), ("Лесная", "улица"), ("Большая Речная", "улица"), ("Мира", "проспект"), ("Северное", "шоссе"), ("Цветной", "бульвар"), ("Кривой", "переулок"), ("Южная", "набережная")),
    cities=("Казань", "Тверь", "Сочи", "Нижний Тагил", "Калуга", "Выборг", "Елец", "Суздаль"),
)
