"""The evaluation over plain documents: gold spans by the shapes that they hold, a masker with known spans, exact verdicts.

With known spans no alignment is needed, and a value that was masked comes back by its placeholder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import luhn_ok
from ..operators import detect

GOLD = (detect.FOREIGN[0], detect.RUSSIAN[0], detect.FOREIGN[1], detect.RUSSIAN[1], detect.FOREIGN[2])


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def gold(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, start, end, type, value, rank, negative): dotted quads, and cards that fail the Luhn check, are look-alikes."""
    found = detect.span_rows(docs.withColumn("spans", detect.spans(detect.claims(F.col("text"), GOLD))), "doc_id", "lang", "source")
    return found.withColumn("negative", (F.col("type") == "IP") | ((F.col("type") == "CARD") & ~luhn_ok(_digits(F.col("value")))))


def masker_spans(docs: DataFrame, patterns: tuple) -> DataFrame:
    return detect.span_rows(docs.withColumn("spans", detect.spans(detect.claims(F.col("text"), patterns))), "doc_id")


def _gold_rows(docs: DataFrame, **detectors: tuple) -> DataFrame:
    """A row per gold span s, with the spans of each detector that meet it, from left to right. In one pass over the texts.

    Texts without a gold span give no row, so that detectors run only on those with one.
    """
    both = detect.with_claims(docs.where(detect.holds(F.col("text"), GOLD)), "text", __vg_gold=GOLD, **detectors)
    each = both.withColumns({k: detect.spans(F.col(k)) for k in detectors}).select("doc_id", "lang", "source", *detectors, F.explode(detect.spans(F.col("__vg_gold"))).alias("s"))
    return each.withColumns({k: F.filter(k, lambda x: (x["start"] < F.col("s.end")) & (F.col("s.start") < x["end"])) for k in detectors})


def _negative() -> Column:
    return (F.col("s.type") == "IP") | ((F.col("s.type") == "CARD") & ~luhn_ok(_digits(F.col("s.value"))))


def observations(docs: DataFrame, patterns: tuple = detect.RUSSIAN) -> DataFrame:
    """A row per gold span: altered if a masked span meets it, covered if one holds all of it, typed as the first that meets it."""
    return _gold_rows(docs, hit=patterns).select(
        "doc_id", "lang", "source", F.concat_ws(":", "doc_id", "s.start").alias("item_id"), F.col("doc_id").cast("string").alias("case_id"), "s.start", F.col("s.type").alias("type"), "s.value", _negative().alias("negative"),
        (F.size("hit") > 0).alias("altered"), F.exists("hit", lambda x: (x["start"] <= F.col("s.start")) & (x["end"] >= F.col("s.end"))).alias("covered"), F.try_element_at("hit", F.lit(1))["type"].alias("typed_as"),
        F.lower("s.type").alias("tool_param"), F.lit(True).alias("round_trip"), F.lit(False).alias("normalised"),
    )


def paired(docs: DataFrame, left: tuple, right: tuple) -> DataFrame:
    """(left, right): for each gold span that is no look-alike whether each of two detectors met it; both in one pass, without a join."""
    rows = _gold_rows(docs, __vg_left=left, __vg_right=right)
    return rows.where(~_negative()).select((F.size("__vg_left") > 0).alias("left"), (F.size("__vg_right") > 0).alias("right"))
