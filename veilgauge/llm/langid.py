"""Language identification by a bit-sliced Bloom filter over character n-grams.

A slot of the filter is a bit mask of languages. Looking an n-gram up is an AND of a few slots, and
yields the mask of all languages that hold it at once. A text's n-grams are counted per language
(popcounts of each bit), the counts are corrected for the share of false positives that the fill of
each language's slice predicts, and the largest corrected count decides.

The n-grams of a language are counted over all labelled rows. One is put into the filter for a
language if it was seen often enough and its frequency there is at least a share of the frequency in
the language where it is most frequent, so that passages in another language do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, small_batches, tidy

GRAM, HASHES = 4, 3
#: The filter has 2**SLOT_BITS slots, or as many more as keep the fullest language's slice half empty, up to MAX_SLOT_BITS
#: (128 MB for each WORD languages); beyond, the correction bears the rest.
SLOT_BITS, MAX_SLOT_BITS = 19, 24
#: Languages of one mask; more languages have more masks.
WORD = 63
MIN_COUNT, MIN_SHARE = 2, 0.1
UNKNOWN = "und"
#: Fixed odd multipliers of the slot hashes.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

_TABLE = np.full(256, 32, np.uint8)
_TABLE[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TABLE[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TABLE[0x80:] = np.arange(0x80, 0x100)


def grams(text: str) -> np.ndarray:
    """Codes of the text's n-grams: GRAM bytes of its letters in lower case, all else a space; with repeats."""
    raw = _TABLE[np.frombuffer(b"  " + text.lower().encode("utf-8", "replace") + b"  ", np.uint8)].astype(np.uint32)
    code = raw[: len(raw) - GRAM + 1].copy()
    for i in range(1, GRAM):
        code |= raw[i : len(raw) - GRAM + 1 + i] << np.uint32(8 * i)
    return code[code != 0x20202020]


def slots(codes: np.ndarray, hashes: int = HASHES, slot_bits: int = SLOT_BITS) -> list[np.ndarray]:
    wide = codes.astype(np.uint64)
    return [((wide + np.uint64(1)) * np.uint64(m)) >> np.uint64(64 - slot_bits) for m in _MIX[:hashes]]


@dataclass
class Model:
    """table: a mask of languages for each slot, a row for each WORD languages; false: the share of false positives by language."""

    languages: list[str]
    table: np.ndarray
    false: np.ndarray
    slot_bits: int = SLOT_BITS

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """Corrected counts by language."""
        n = len(codes)
        at = slots(codes, slot_bits=self.slot_bits)
        found = np.zeros(len(self.languages))
        for w, own in enumerate(self.table):
            mask = own[at[0]]
            for s in at[1:]:
                mask = mask & own[s]
            for i in range(w * WORD, min((w + 1) * WORD, len(found))):
                found[i] = ((mask >> np.uint64(i % WORD)) & np.uint64(1)).sum()
        return np.clip((found - n * self.false) / (1 - np.minimum(self.false, 0.999)), 0, n)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        counts = self.counts(grams(text))
        total = counts.sum()
        best = int(np.argmax(counts))
        return self.languages[best], float(counts[best] / total) if total else 1 / len(self.languages)


def held_out(row_id, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(row_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def train(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the rows of df with a text and a language; equal counts at every size, whatever the partitions.

    The driver gets a row per language and per used slot, 2**MAX_SLOT_BITS at most for each WORD languages. Repeated rows
    count as often as they stand; an empty table gives a model without languages.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, parts in by.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in held:
                    both, at = np.unique(np.concatenate([held[lang][0], codes]), return_inverse=True)
                    codes, n = both, np.bincount(at, weights=np.concatenate([held[lang][1], n])).astype(np.int64)
                held[lang] = (codes, n)
            if sum(len(c) for c, _ in held.values()) > 2_000_000:
                yield from _drain(held)
        yield from _drain(held)

    def _drain(held):
        for lang in list(held):
            codes, n = held.pop(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    seen = materialize(rows.mapInArrow(tidy(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "grams")
    totals = seen.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").collect()  # languages, few by nature
    languages = [r["lang"] for r in totals]
    bits, words = SLOT_BITS, max(1, -(-len(languages) // WORD))
    table = np.zeros((words, 1 << bits), np.uint64)
    if languages:
        number = spark.createDataFrame([(r["lang"], i, r["total"]) for i, r in enumerate(totals)], "lang string, i int, total long")
        rate = F.col("n") / F.col("total")
        best = F.max(rate).over(Window.partitionBy("code"))
        inside = seen.join(F.broadcast(number), "lang").withColumns({"rate": rate, "best": best}).where((F.col("n") >= MIN_COUNT) & (F.col("rate") >= MIN_SHARE * F.col("best")))
        inside = materialize(inside.select("i", "code"), "entries")
        most = inside.groupBy("i").count().agg(F.max("count")).first()[0] or 1
        bits = min(MAX_SLOT_BITS, max(SLOT_BITS, math.ceil(math.log2(2 * HASHES * most))))
        table = np.zeros((words, 1 << bits), np.uint64)

        @F.arrow_udf("array<long>")
        def _slots(code: pa.Array) -> pa.Array:
            at = np.stack(slots(code.to_numpy(zero_copy_only=False).astype(np.uint32), slot_bits=bits), axis=1).astype(np.int64)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32)), pa.array(at.ravel()))

        used = inside.select("i", F.explode(_slots("code")).alias("slot")).groupBy((F.col("i") / WORD).cast("int").alias("word"), "slot")
        got = used.agg(F.bit_or(F.expr(f"shiftleft(1L, i % {WORD})")).alias("mask")).toArrow()
        table[got["word"].to_numpy(), got["slot"].to_numpy()] = got["mask"].to_numpy().astype(np.uint64)
    fill = np.array([float(((table[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean()) for i in range(len(languages))])
    return Model(languages, table, fill**HASHES, bits)


def predict(df: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score (columns of these names are replaced).

    lang_pred: a learned language, the first of equals by name; ``und``, with the score 0, where the
    text is null or has no letter, or nothing was learned. score: the language's part of all corrected counts.
    """
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)  # 2**MAX_SLOT_BITS masks at most for each WORD languages

    @F.arrow_udf("struct<lang: string, score: double>")
    def _predict(texts: pa.Array) -> pa.Array:
        found = [held.value.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang", "score"])

    out = df.withColumn("__vg_p", _predict(F.col(f"`{text_col}`")))
    return out.withColumns({"lang_pred": F.col("__vg_p.lang"), "score": F.col("__vg_p.score")}).drop("__vg_p")
