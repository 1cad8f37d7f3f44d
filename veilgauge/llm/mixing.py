"""Temperature mixing of sources, realised as budgeted block permutations.

A source with the share p of all tokens gets the weight p ** a, normalised. The exponent a is found
by bisection, so that the weights reach a target entropy, or so that no source is repeated more often
than a limit. Weights times a token budget are the sources' budgets. A budget is met by whole passes
over the source, each in a permutation of its own, and a part of one more pass: the documents that
start before the budget ends. The stream is dealt into blocks of equal budget; each block holds every
source at its weight, and is shuffled.

Permutations are orders of MD5 keys of (id, pass). Sums ahead of a document are taken in two steps,
over cells of leading key digits and then inside a cell, so that no task sees a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, small_enough

MAX_REPEATS, BLOCK_TOKENS = 2.0, 1 << 20
#: A table of more sources than these stays distributed; fewer go to the driver.
MAX_SOURCES = 100_000
#: Rows of a source's pass that a cell of the key should hold at most.
CELL_ROWS = 1 << 16
#: Fixed: a token here is a run of characters other than ASCII white space.
WORD, SPACE = r"[^\x20\x09-\x0D]+", " \t\n\x0b\f\r"


def weights(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raw = [(n / total) ** exponent for n in tokens]
    scale = sum(raw)
    return [x / scale for x in raw]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def repeats(tokens: list[int], w: list[float]) -> float:
    """The most passes over a source, if the budget is the least that uses every source once."""
    budget = max(n / x for n, x in zip(tokens, w, strict=True))
    return max(x * budget / n for n, x in zip(tokens, w, strict=True))


def solve_exponent(tokens: list[int], *, max_repeats: float | None = None, target_entropy: float | None = None, steps: int = 100) -> float:
    """The least exponent in [0, 1] within max_repeats, or the largest that reaches target_entropy (in nats); tokens > 0.

    At 0 sources are even and repeats greatest, at 1 they are as found. An entropy out of reach gives 0 or 1.
    """
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give max_repeats or target_entropy")
    if max_repeats is not None and max_repeats < 1:
        raise ValueError("max_repeats must be 1 or more")
    if not tokens:
        return 1.0

    def low_enough(a: float) -> bool:
        w = weights(tokens, a)
        return repeats(tokens, w) <= max_repeats if max_repeats is not None else entropy(w) <= target_entropy

    if low_enough(0.0):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if low_enough(mid) else (mid, hi)
    return hi


def token_count(text: Column) -> Column:
    """Words of a text, 0 of null: each is shrunk to one character. (regexp_count would build the list of all words.)"""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "w"), SPACE, "")), F.lit(0)).cast("long")


def _key(row_id: Column, n: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(row_id.cast("string"), F.lit("null")), n.cast("string")).cast("binary"))


_BUDGETS = "source string, tokens long, weight double, budget long, passes long, rest long, quota long"


def budgets(spark, found: list[tuple[str | None, int]], *, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row per source: tokens, weight, budget, whole passes, the rest of the budget, and its quota of a block.

    budget: tokens of the whole mixture; by default the least with which every source is used once.
    A source without tokens has one pass of its documents.
    """
    real = [(s, n) for s, n in found if n > 0]
    rows = [(s, 0, 0.0, 0, 1, 0, 1) for s, n in found if n <= 0]
    if real:
        tokens = [n for _, n in real]
        w = weights(tokens, solve_exponent(tokens, max_repeats=None if target_entropy is not None else max_repeats, target_entropy=target_entropy))
        total = budget if budget is not None else max(n / x for n, x in zip(tokens, w, strict=True))
        for (s, n), x in zip(real, w, strict=True):
            own = int(math.floor(x * total + 0.5))
            if budget is None:  # rounding must not cost a source its first pass
                own = max(own, n)
            rows.append((s, n, x, own, own // n, own % n, max(1, int(math.floor(x * block_tokens + 0.5)))))
    return spark.createDataFrame(rows, _BUDGETS)


def _narrow(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), token_count(text).alias("tokens"), F.xxhash64(text).alias("th"))
    return materialize(rows, "tokens")


def _budget_table(rows: DataFrame, **how) -> DataFrame:
    sums = materialize(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    if not small_enough(sums, MAX_SOURCES):
        return materialize(_many_budgets(sums, **how), "budgets")
    return budgets(rows.sparkSession, sorted((tuple(r) for r in sums.collect()), key=lambda r: (r[0] is not None, r[0] or "")), **how)


def _many_budgets(sums: DataFrame, *, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """What budgets() gives, where sources are too many for the driver: a pass over them measures many exponents at once.

    Sums of floating-point numbers depend on their order, so that a budget may differ from that of budgets() by a token.
    """
    real = sums.where("tokens > 0")
    total, top, low = real.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens")).first()
    share = F.col("tokens") / F.lit(total)

    def low_enough(exponents: list[float]) -> list[bool]:
        if target_entropy is None:  # the most passes are those over the smallest source
            return [(top / low) ** (1 - a) <= max_repeats for a in exponents]
        scale = [F.sum(F.pow(share, F.lit(a))) for a in exponents]
        logs = [F.sum(F.pow(share, F.lit(a)) * F.log(share)) for a in exponents]
        found = list(real.agg(*scale, *logs).first())
        return [math.log(s) - a * t / s <= target_entropy for a, s, t in zip(exponents, found, found[len(exponents) :], strict=False)]

    if max_repeats is not None and target_entropy is None and max_repeats < 1:
        raise ValueError("max_repeats must be 1 or more")
    lo, hi = 0.0, 1.0
    if total is not None and low_enough([0.0])[0]:
        hi = 0.0
    while total is not None and hi - lo > 1e-15 * hi:
        grid = [lo + (hi - lo) * i / 16 for i in range(1, 16)]
        fits = low_enough(grid)
        at = fits.index(True) if True in fits else len(grid)
        new = (grid[at - 1] if at else lo, grid[at] if at < len(grid) else hi)
        if new == (lo, hi):
            break
        lo, hi = new
    scale = real.agg(F.sum(F.pow(share, F.lit(hi)))).first()[0]
    weight = F.pow(share, F.lit(hi)) / F.lit(scale)
    whole = budget if budget is not None else real.agg(F.max(F.col("tokens") / weight)).first()[0]
    own = F.floor(weight * F.lit(whole) + 0.5).cast("long")
    own = F.greatest(own, "tokens") if budget is None else own
    some = F.col("tokens") > 0
    out = sums.withColumns({"weight": F.when(some, weight).otherwise(0.0), "budget": F.when(some, own).otherwise(0)})
    quota = F.greatest(F.lit(1), F.floor(F.col("weight") * block_tokens + 0.5).cast("long"))
    return out.select("source", "tokens", "weight", F.col("budget").cast("long").alias("budget"), F.when(some, F.expr("budget div tokens")).otherwise(1).cast("long").alias("passes"), F.when(some, F.col("budget") % F.col("tokens")).otherwise(0).cast("long").alias("rest"), quota.cast("long").alias("quota"))


def _digits(rows: DataFrame) -> int:
    """Hex digits of the key that make cells small, even if one source has all rows."""
    return max(2, math.ceil(math.log(max(1, rows.count() / CELL_ROWS), 16)))


def _side(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if small_enough(table, MAX_SOURCES) else table


def _placed(rows: DataFrame, table: DataFrame, digits: int, last_only: bool = False) -> DataFrame:
    """rows once for each pass that they may be in (or for a part pass only), with the tokens ahead of them in it (ahead)."""
    t = _side(table.where("rest > 0") if last_only else table).alias("t")
    both = rows.alias("r").join(t, F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", *[f"t.{c}" for c in ("passes", "rest", "quota")], F.col("t.tokens").alias("source_tokens"))
    last = F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1)
    numbers = F.array("passes") if last_only else F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last))
    each = both.withColumn("pass", F.explode(numbers)).withColumn("key", _key(F.col("doc_id"), F.col("pass")))
    each = each.withColumns({"cell": F.substring("key", 1, digits), "no_source": F.col("source").isNull(), "source_key": F.coalesce("source", F.lit(""))})
    at = ["no_source", "source_key", "pass", "cell"]
    sums = each.groupBy(*at).agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy(*at[:3]).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sums.select(*at, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "cells")
    inside = Window.partitionBy(*at).orderBy("key", "tokens", "th").rowsBetween(Window.unboundedPreceding, -1)
    own = each.withColumn("own", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return own.join(F.broadcast(starts) if small_enough(starts) else starts, at).withColumn("ahead", F.col("base") + F.col("own")).drop("own", "base", "cell", *at[:2])


def mixture(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", digits: int | None = None, **how) -> DataFrame:
    """The mixed stream: doc_id, source, pass, tokens, block, slot; one row for each use of a document.

    how: as for budgets(). A null source is a source. Null and empty texts have no tokens and come with
    the pass. Rows with one id share their place in the permutation; among them fewer tokens come
    first. An empty table gives no rows. slot: 0, 1, ... in each block, in shuffled order.
    digits: hex digits of the key that make a cell, by default as many as the rows need; it changes no result.
    """
    rows = _narrow(df, id_col, text_col, source_col)
    placed = _placed(rows, _budget_table(rows, **how), digits or _digits(rows))
    used = placed.where((F.col("pass") < F.col("passes")) | (F.col("ahead") < F.col("rest")))
    used = used.withColumn("block", F.expr("(pass * source_tokens + ahead) div quota"))
    order = Window.partitionBy("block").orderBy(F.md5(F.concat_ws(":", "key", "block").cast("binary")), "tokens", "th")
    return used.select("doc_id", "source", "pass", "tokens", "block", (F.row_number().over(order) - 1).cast("long").alias("slot"))


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", digits: int | None = None, **how) -> DataFrame:
    """df's rows, each as often as the mixture uses it, with df's columns.

    The texts are not exchanged: a source's part of a pass is the rows whose key is at most that of the
    last document in it (rows with one id go together). Null sources, ids and texts, and an empty table, are as for mixture().
    """
    rows = _narrow(df, id_col, text_col, source_col)
    table = _budget_table(rows, **how)
    placed = _placed(rows, table, digits or _digits(rows), last_only=True)
    ends = placed.where(F.col("ahead") < F.col("rest")).groupBy("source").agg(F.max("key").alias("end"))
    uses = table.alias("t").join(ends.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left").select(F.col("t.source").alias("__vg_source"), F.col("passes").alias("__vg_passes"), F.col("end").alias("__vg_end"))
    uses = materialize(uses, "uses")
    joined = df.withColumn("__vg_s", F.col(f"`{source_col}`").cast("string")).join(_side(uses), F.col("__vg_s").eqNullSafe(F.col("__vg_source")))
    more = F.when(_key(F.col(f"`{id_col}`").cast("long"), F.col("__vg_passes")) <= F.col("__vg_end"), 1).otherwise(0)
    times = (F.col("__vg_passes") + more).cast("int")
    return joined.withColumn("__vg_n", F.explode(F.array_repeat(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in df.columns])

