"""Report lines from observations: conditional counts, one axis at a time, exact intervals, paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

REWRITE_FLAG = 0.3


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def item_counts() -> dict[str, tuple[Column, Column]]:
    """(hits, total) of the lines that items give. round_trip counts altered items only, end_to_end all of them."""
    c = F.col
    judged = c("tool_param").isNotNull() & c("round_trip").isNotNull()
    return {
        "leak": (_count(c("altered")), F.count("*")),
        "coverage": (_count(c("covered")), F.count("*")),
        "typed": (_count(c("typed_as") == c("type")), F.count("typed_as")),
        "round_trip": (_count(judged & c("altered") & c("round_trip")), _count(judged & c("altered"))),
        "round_trip_repaired": (_count(judged & c("altered") & (c("round_trip") | c("normalised"))), _count(judged & c("altered"))),
        "end_to_end": (_count(judged & c("round_trip")), _count(judged)),
    }


#: Lines that are left out where nothing was measured, rather than shown as 0 of 0.
OPTIONAL = ("typed", "consistency", "stability")


def _lines(df: DataFrame, counts: dict[str, tuple[Column, Column]], keys: list[str]) -> DataFrame:
    aggs = [x.cast("long").alias(f"{name}_{what}") for name, pair in counts.items() for what, x in zip(("hits", "total"), pair, strict=True)]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("line"), F.col(f"{n}_hits").alias("hits"), F.col(f"{n}_total").alias("total")) for n in counts])
    long = wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    return long.where(~F.col("line").isin(*OPTIONAL) | (F.col("total") > 0))


def lines(items: DataFrame, negatives: DataFrame | None = None, cases: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, line, hits, total): one pass over each kind of observation."""
    by = list(keys)
    out = _lines(items, item_counts(), by)
    if negatives is not None:
        out = out.unionByName(_lines(negatives, {"overmask": (_count(~F.col("touched")), F.count("*"))}, by))
    if cases is not None:
        whole = {n: (_count(F.col(n)), F.count(n)) for n in ("consistency", "stability")}
        out = out.unionByName(_lines(cases, whole, by))
    return out


def lines_in_one(items: DataFrame) -> DataFrame:
    """(line, hits, total) as lines() gives, of items with look-alikes among them (negative): overmask counts those, the rest the others.

    One pass over what makes the items; as two tables it would be made twice.
    """
    c = F.col
    own = ~c("negative")
    masked = [F.when(own, c(n)).alias(n) for n in ("altered", "covered", "typed_as", "tool_param", "round_trip", "normalised")]
    counts = item_counts() | {"overmask": (_count(c("negative") & ~c("touched")), _count(c("negative")))}
    counts |= {n: (counts[n][0], _count(own)) for n in ("leak", "coverage")}
    return _lines(items.select("type", "negative", c("altered").alias("touched"), *masked), counts, [])


def with_intervals(found: DataFrame) -> DataFrame:
    """Adds rate, low, high and certifies (for a line without a failure, else null)."""
    out = found.withColumn("_i", stats.interval_column(F.col("hits"), F.col("total")))
    rate = F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0)
    sure = F.when((F.col("total") > 0) & (F.col("hits") == F.col("total")), stats.certified(F.col("total")))
    return out.withColumns({"rate": rate, "low": F.col("_i.low"), "high": F.col("_i.high"), "certifies": sure}).drop("_i")


def by_axis(items: DataFrame, axes: dict[str, str | Column]) -> DataFrame:
    """(axis, key, line, hits, total): grouping sets of single axes, never crossed; rows without a key drop out of that axis."""
    pairs = F.array(*[F.struct(F.lit(name).alias("axis"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("key")) for name, c in axes.items()])
    each = items.withColumn("_a", F.explode(pairs)).select("*", "_a.axis", "_a.key").drop("_a").where("key IS NOT NULL")
    return _lines(each, item_counts(), ["axis", "key"])


def counters(items: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: cases, errors, calls_made, calls_parsed, rewrite_flagged, unattributable, normalised."""
    a = cases.agg(
        F.count("*").alias("cases"),
        _count(F.col("error").isNotNull()).alias("errors"),
        _count(F.col("call_made")).alias("calls_made"),
        _count(F.col("arguments_parse")).alias("calls_parsed"),
        _count(F.col("rewrite_ratio") > REWRITE_FLAG).alias("rewrite_flagged"),
    )
    b = items.agg(_count(F.col("shared_block") & F.col("tool_param").isNotNull()).alias("unattributable"), _count(F.col("normalised")).alias("normalised"))
    return a.join(b, F.lit(True))  # two single rows


OUTCOME = {"leak": "altered", "coverage": "covered", "end_to_end": "round_trip", "overmask": "NOT touched"}


def paired(left: DataFrame, right: DataFrame, line: str, keys: tuple[str, ...] = ("case_id", "item_id")) -> DataFrame:
    """One row (b, c, shared): keys where only left passed, only right, and all that both measured."""
    if line not in OUTCOME:
        raise ValueError(f"{line} is not compared item by item")
    a, b = (d.select(*keys, F.expr(OUTCOME[line]).alias(name)).where(f"{name} IS NOT NULL") for d, name in ((left, "_l"), (right, "_r")))
    both = a.join(b, list(keys))
    return both.agg(_count(F.col("_l") & ~F.col("_r")).alias("b"), _count(F.col("_r") & ~F.col("_l")).alias("c"), F.count("*").alias("shared"))


def with_p(found: DataFrame) -> DataFrame:
    """Adds McNemar's exact p; null where nothing is shared."""
    return found.withColumn("p", F.when(F.col("shared") > 0, stats.mcnemar_column(F.col("b"), F.col("c"))))
