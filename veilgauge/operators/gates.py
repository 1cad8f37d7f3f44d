"""Checks of a corpus: structure, passthrough, discrimination, strata, staleness. Each is a DataFrame of what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..sources.cases import gold_items, messages, negatives

# The bounds of the strata.
MAX_HARD, NAME_TIER, MIN_REGISTER, MIN_FAMILY, MIN_NO_CUE = 0.5, (0.25, 0.60), 0.20, 30, 0.30


def _text(c) -> F.Column:
    return c.cast("string")


def defects(cases: DataFrame, canary: str | None = None, license: str | None = None) -> DataFrame:
    """(case_id, rule, detail): structural defects; none for a sound corpus."""
    users = messages(cases).where("role = 'user'").select("case_id", "turn", "content")
    items = gold_items(cases).join(users, ["case_id", "turn"], "left")
    negs = negatives(cases).join(users, ["case_id", "turn"], "left")

    def rows(df: DataFrame, cond, rule: str, detail) -> DataFrame:
        return df.where(cond).select("case_id", F.lit(rule).alias("rule"), _text(detail).alias("detail"))

    def misplaced(df):
        return F.substring(df["content"], df["start"] + 1, df["end"] - df["start"]) != df["value"]

    name = F.col("type") == "NAME"
    out = [
        rows(items, F.col("content").isNull(), "item_turn", F.col("item_id")),
        rows(items, misplaced(items), "item_offsets", F.col("item_id")),
        rows(items, F.col("content").isNotNull() & ~F.col("type").isin(*schema.TYPES), "item_type", F.col("item_id")),
        rows(items, F.col("content").isNotNull() & name & ~F.coalesce(F.col("tier").isin(*schema.TIERS), F.lit(False)), "name_tier", F.col("item_id")),
        rows(items, F.col("content").isNotNull() & ~name & F.col("tier").isNotNull(), "tier_on_other", F.col("item_id")),
        rows(negs, F.col("content").isNull(), "negative_turn", F.col("value")),
        rows(negs, misplaced(negs), "negative_offsets", F.col("value")),
        rows(negs, F.col("content").isNotNull() & ~F.col("kind").isin(*schema.NEGATIVE_KINDS), "negative_kind", F.col("value")),
    ]
    whole = cases.withColumnRenamed("id", "case_id")
    out.append(rows(whole, F.coalesce(F.size("negatives"), F.lit(0)) < 1, "no_negatives", F.lit("")))
    out.append(overlaps(cases))
    offered = F.transform("tools", lambda t: t["function"]["name"])
    out.append(rows(whole, ~F.coalesce(F.array_contains(offered, F.col("expected_call.name")), F.lit(False)), "tool_not_offered", F.col("expected_call.name")))
    none = F.array().cast("array<string>")
    fed = F.flatten(F.transform("pii", lambda p: F.concat(F.array(p["tool_param"]), F.coalesce(F.map_keys(p["parts"]), none))))
    unfed = F.array_except(F.coalesce("expected_call.pii_params", none), F.coalesce(fed, none))
    out.append(whole.select("case_id", F.explode(unfed).alias("detail")).select("case_id", F.lit("param_unfed").alias("rule"), "detail"))
    out.append(rows(whole, ~F.col("family").isin(*schema.FAMILIES), "family", F.col("family")))
    out.append(rows(whole, ~F.col("register").isin(*schema.REGISTERS), "register", F.col("register")))
    out.append(rows(whole, F.col("subcase").isNotNull() & ~F.col("subcase").isin(*schema.SUBCASES), "subcase", F.col("subcase")))
    if canary is not None:
        out.append(rows(whole, ~F.col("canary").eqNullSafe(canary), "canary", F.col("canary")))
    if license is not None:
        out.append(rows(whole, ~F.col("license").eqNullSafe(license), "license", F.col("license")))
    return reduce(DataFrame.unionByName, out)


def overlapping(spans: DataFrame, *keys: str) -> DataFrame:
    """spans (keys, start, end, label) whose next span of the same keys begins before they end; neighbours only."""
    w = Window.partitionBy(*keys).orderBy("start", "end", "label")
    return spans.withColumn("next_start", F.lead("start").over(w)).withColumn("next_label", F.lead("label").over(w)).where("next_start < end")


def overlaps(cases: DataFrame) -> DataFrame:
    both = gold_items(cases).select("case_id", "turn", "start", "end", F.col("item_id").alias("label")).unionByName(negatives(cases).select("case_id", "turn", "start", "end", F.col("value").alias("label")))
    found = overlapping(both, "case_id", "turn")
    return found.select("case_id", F.lit("overlap").alias("rule"), F.concat_ws(" / ", "label", "next_label").alias("detail"))


def passthrough(items: DataFrame, negs: DataFrame) -> DataFrame:
    """One row: the identity masker must leak nothing, deliver all, touch nothing, over at least one item."""
    a = items.agg(F.count_if("altered").alias("altered"), F.count_if(F.col("round_trip") & F.col("tool_param").isNotNull()).alias("delivered"), F.count_if(F.col("tool_param").isNotNull() & F.col("round_trip").isNotNull()).alias("judged"))
    b = negs.agg(F.count_if("touched").alias("touched"))
    return a.join(b, F.lit(True)).withColumn("ok", (F.col("altered") == 0) & (F.col("delivered") == F.col("judged")) & (F.col("touched") == 0) & (F.col("judged") > 0))


def unmarked(items: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases not declared hard in which the naive masker altered nothing."""
    touched = items.where("altered").select("case_id").distinct()
    return cases.where("NOT hard").join(touched, "case_id", "left_anti").select("case_id")


def strata(cases: DataFrame) -> DataFrame:
    """(stratum, value, low, high, ok): shares and counts against their bounds; only what is present is tested."""
    names = gold_items(cases).where("type = 'NAME'")
    one = F.lit(1.0)
    rows = [
        cases.agg(F.lit("hard").alias("stratum"), F.avg(F.col("hard").isNotNull().cast("int")).alias("value")).select("*", F.lit(0.0).alias("low"), F.lit(MAX_HARD).alias("high")),
        names.agg(F.lit("name_tier").alias("stratum"), F.avg((~F.col("tier").eqNullSafe("common")).cast("int")).alias("value")).select("*", F.lit(NAME_TIER[0]).alias("low"), F.lit(NAME_TIER[1]).alias("high")),
        names.agg(F.lit("name_no_cue").alias("stratum"), F.avg((~F.col("cue")).cast("int")).alias("value")).select("*", F.lit(MIN_NO_CUE).alias("low"), one.alias("high")),
        cases.groupBy("register").agg(F.count("*").alias("n")).select(F.concat(F.lit("register:"), "register").alias("stratum"), (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("value"), F.lit(MIN_REGISTER).alias("low"), one.alias("high")),
        cases.groupBy("family").agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit("family:"), "family").alias("stratum"), "value", F.lit(float(MIN_FAMILY)).alias("low"), F.lit(float("inf")).alias("high")),
    ]
    out = reduce(DataFrame.unionByName, rows).where("value IS NOT NULL")
    return out.withColumn("ok", F.col("value").between(F.col("low"), F.col("high")))


def stale(manifests: DataFrame, digest: str) -> DataFrame:
    """Runs that were measured over another corpus."""
    return manifests.where(~F.col("corpus_digest").eqNullSafe(digest))
