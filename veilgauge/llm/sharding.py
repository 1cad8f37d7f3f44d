"""Histogram sort: documents go into shards of near equal bytes with a single exchange.

A row's key is (hash of its text, hash of its id), so that equal texts are neighbours. Each round
counts, exactly and over all partitions, the bytes below a grid of candidate boundaries inside the
intervals that are still open, and keeps for every splitter the one grid cell that holds its target.
A splitter is settled as soon as a boundary lies within the tolerance of its target. A text whose
copies weigh more than the tolerance is cut further by the second part of the key; lighter groups
of equal texts stay whole. Then every row's shard is a function of its key.

Main path: DataFrame operations only.
"""

from __future__ import annotations

import math
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, small_enough

#: Bits of the key that one round resolves.
FAN_BITS = 10
#: Rows that a cell of the numbering should hold, or a millionth of all rows if that is more.
CELL_ROWS = 256
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def _keys(text: Column, row_id: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), row_id)


def _after(h: int, g: int) -> tuple[int, int]:
    """The next key; that of the last is the last itself, which leaves one key where it would not matter."""
    return (h, g + 1) if g < LONG_MAX else (min(h + 1, LONG_MAX), LONG_MIN)


def find_splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """shards - 1 keys (h, g), ascending; a row belongs right of those that are <= its own key.

    keys: a table (h long, g long, size long) that is cheap to read again. The driver sees at most
    (shards - 1) * 2**FAN_BITS counts a round.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [(LONG_MAX, LONG_MAX)] * (shards - 1)
    slack = tolerance * total / shards
    done: dict[int, tuple[int, int]] = {}
    # splitter -> (bytes below its open cell, the cell: None, a prefix of h, or (h,) or (h, prefix of g))
    open_h: dict[int, tuple[int, int | None]] = {i: (0, None) for i in range(1, shards)}
    open_g: dict[int, tuple[int, int, int | None]] = {}

    def settle(i: int, rows: list, below: int):
        """The cell among the rows (sorted) that holds the target, or None if the splitter is now settled."""
        target = total * i / shards
        for r in rows:
            if below + r["bytes"] >= target:
                lo, hi = target - below, below + r["bytes"] - target
                if lo <= slack or hi <= slack or (r["h0"] == r["h1"] and r["g0"] == r["g1"]):
                    done[i] = (r["h0"], r["g0"]) if lo <= hi else _after(r["h1"], r["g1"])
                    return None
                return r, below
            below += r["bytes"]
        done[i] = (LONG_MAX, LONG_MAX)
        return None

    aggs = [F.sum("size").alias("bytes"), F.min("h").alias("h0"), F.max("h").alias("h1")]
    bits = 64
    while open_h and bits:
        before, bits = bits, max(0, bits - FAN_BITS)
        cells = sorted({c for _, c in open_h.values() if c is not None})
        level = keys.where(F.shiftright("h", before).isin(cells)) if cells else keys
        found = level.groupBy(F.shiftright("h", bits).alias("cell")).agg(*aggs).collect()
        found = [{**r.asDict(), "g0": LONG_MIN, "g1": LONG_MAX} for r in sorted(found)]
        by = {k: list(v) for k, v in groupby(found, lambda r: None if not cells else r["cell"] >> (before - bits))}
        for i, (below, cell) in sorted(open_h.items()):
            del open_h[i]
            if at := settle(i, by.get(cell, []), below):
                r, below = at
                if r["h0"] == r["h1"]:
                    open_g[i] = (below, r["h0"], None)
                else:
                    open_h[i] = (below, r["cell"])
    aggs = [F.sum("size").alias("bytes"), F.min("g").alias("g0"), F.max("g").alias("g1")]
    bits = 64
    while open_g:
        before, bits = bits, max(0, bits - FAN_BITS)
        level = keys.where(F.col("h").isin(sorted({h for _, h, _ in open_g.values()})))
        if cells := sorted({c for _, _, c in open_g.values() if c is not None}):
            level = level.where(F.shiftright("g", before).isin(cells))
        found = level.groupBy("h", F.shiftright("g", bits).alias("cell")).agg(*aggs).collect()
        by = {}
        for r in sorted(found):
            by.setdefault((r["h"], r["cell"] >> (before - bits) if cells else None), []).append({**r.asDict(), "h0": r["h"], "h1": r["h"]})
        for i, (below, h, cell) in sorted(open_g.items()):
            del open_g[i]
            if at := settle(i, by.get((h, cell), []), below):
                open_g[i] = (at[1], h, at[0]["cell"])
    return sorted(done[i] for i in range(1, shards))


def shard_of(h: Column, g: Column, splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters <= (h, g), as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        sh, sg = splitters[mid]
        right = (h > F.lit(sh)) | ((h == F.lit(sh)) & (g >= F.lit(sg)))
        return F.when(right, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(splitters)).cast("int")


def histogram_sort(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, tolerance: float = 0.005, overhead: int = 16) -> DataFrame:
    """df with size, text_crc32, shard and slot; law ``bytes``: sizes of the shards are near equal.

    size: UTF-8 bytes of the text plus ``overhead`` (a null text has no bytes; its CRC-32 is that of
    the empty text). slot: 0, 1, ... in each shard, in the order of the key. A splitter lies within
    ``tolerance`` of a shard's mean size from its target, or next to it where single rows are larger.
    Null ids are keys like others. Rows equal in text and id have one key and stay in one shard. An
    empty table has no rows. Columns of df named like the added ones are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    h, g = _keys(F.col(f"`{text_col}`"), F.col(f"`{id_col}`"))
    size = (F.octet_length(text) + F.lit(overhead)).cast("long")
    keys = materialize(df.select(h.alias("h"), g.alias("g"), size.alias("size")), "sharding")
    splitters = find_splitters(keys, shards, tolerance)
    # Within a shard rows are numbered by cells of the key: its leading bits, as many as keep the cells small; a cell that a
    # text with very many copies crowds is parted further, by the second part of the key.
    n = keys.count()
    cell_rows = max(CELL_ROWS, n >> 20)
    bits = max(1, math.ceil(math.log2(max(2, n / cell_rows))))

    def cells(table: DataFrame, h: Column, g: Column) -> DataFrame:
        near = table.withColumns({"__vg_s": shard_of(h, g, splitters), "__vg_c": F.shiftright(h, 64 - bits)})
        near = near.join(crowded, ["__vg_s", "__vg_c"], "left")
        return near.withColumns({"__vg_ch": F.when(F.col("__vg_full"), h).otherwise(0), "__vg_cg": F.when(F.col("__vg_full"), F.shiftright(g, 64 - max(bits, FAN_BITS))).otherwise(0)}).drop("__vg_full")

    sizes = keys.groupBy(shard_of(F.col("h"), F.col("g"), splitters).alias("__vg_s"), F.shiftright("h", 64 - bits).alias("__vg_c")).count()
    crowded = materialize(sizes.where(F.col("count") > 4 * cell_rows).select("__vg_s", "__vg_c", F.lit(True).alias("__vg_full")), "crowded")
    crowded = F.broadcast(crowded) if small_enough(crowded) else crowded
    cell = ["__vg_s", "__vg_c", "__vg_ch", "__vg_cg"]
    counts = cells(keys, F.col("h"), F.col("g")).groupBy(*cell).count()
    ahead = Window.partitionBy("__vg_s").orderBy(*cell[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select(*cell, F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__vg_start")), "cells")
    starts = F.broadcast(starts) if small_enough(starts) else starts
    rows = df.drop("size", "text_crc32", "shard", "slot").withColumns({"__vg_h": h, "__vg_g": g, "size": size, "text_crc32": F.crc32(text.cast("binary"))})
    rows = cells(rows, F.col("__vg_h"), F.col("__vg_g"))
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("__vg_h", "__vg_g")) - 1
    out = rows.withColumn("__vg_rank", rank).join(starts, cell)
    out = out.withColumns({"shard": F.col("__vg_s"), "slot": (F.col("__vg_start") + F.col("__vg_rank")).cast("long")})
    return out.drop(*cell, "__vg_h", "__vg_g", "__vg_rank", "__vg_start")
