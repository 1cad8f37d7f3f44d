"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, ship_package

#: Arrow batches hold at most this many rows and bytes, so that a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1024, 32 << 20
#: A side of a join is broadcast only if its counted rows are at most this many (rows of under 100 bytes).
BROADCAST_ROWS = 200_000


def new_path(spark: SparkSession, tag: str) -> str:
    return shared_path(spark, tag)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns a scan of it: lineage is cut, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns what a Python worker has freed to the system: workers outlive their tasks, and other stages need the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function over the batches of a partition that gives memory back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        give_back()

    return run


def small_batches(spark: SparkSession) -> None:
    """Readies the session for Python workers: their package, and batches of bounded memory for the plans made from now on."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns by exact name (else by name in any case), under new names; other columns, clashing ones too, go.

    ``pick(df, did="doc_id")`` has the one column ``did``. Resolves by position, so that further
    columns whose names differ in case only make nothing ambiguous.
    """
    at = []
    for name in wanted.values():
        hits = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not hits:
            raise ValueError(f"no column {name!r} among {df.columns}")
        at.append(hits[0])
    flat = df.toDF(*[f"__vg_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"__vg_{i}").alias(new) for i, new in zip(at, wanted, strict=True)])


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df, a materialised table, may be broadcast."""
    return df.limit(rows + 1).count() <= rows


#: Bits of a key bitmap: 8 MB at most, whatever the number of keys.
KEY_BITS = 1 << 26


def _bit(key: Column) -> Column:
    return F.pmod(key, F.lit(KEY_BITS))


def key_bitmap(keys: DataFrame, key: Column) -> DataFrame:
    """The bits of some 64-bit keys, in rows of 4 kB; never more than KEY_BITS bits."""
    bits = keys.select(F.bitmap_bucket_number(_bit(key)).alias("__vg_bucket"), F.bitmap_bit_position(_bit(key)).alias("p"))
    return bits.groupBy("__vg_bucket").agg(F.bitmap_construct_agg("p").alias("__vg_bits"))


def maybe_among(df: DataFrame, key: Column, bitmap: DataFrame, flag: str) -> DataFrame:
    """df with a column flag that is false only where the key is surely not among the bitmap's.

    Rows that a join would not touch need not be exchanged for it. Past some hundred million keys the bitmap is full
    and tells nothing; it never changes a result.
    """
    rows = df.withColumns({"__vg_bucket": F.bitmap_bucket_number(_bit(key)), "__vg_p": F.bitmap_bit_position(_bit(key))})
    both = rows.join(F.broadcast(bitmap), "__vg_bucket", "left")
    set_ = F.expr("shiftright(cast(conv(hex(substring(__vg_bits, cast(__vg_p div 8 as int) + 1, 1)), 16, 10) as int), cast(__vg_p % 8 as int)) & 1") == 1
    return both.withColumn(flag, F.coalesce(set_, F.lit(False))).drop("__vg_bucket", "__vg_p", "__vg_bits")
