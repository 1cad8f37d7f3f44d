"""Quality rules: per-text measures, and cross-document line frequency.

A line that many distinct documents of one host carry is a template, not content. Lines are
normalised (A-Z lower-cased, white space collapsed) and hashed; for each host the distinct texts with
a line are counted, so exact copies of one page count once. Lines above the limit are removed, and a
document that is left with too small a share of its words is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, materialize, small_batches, small_enough, tidy

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
#: Defaults in production: a line is a template if over MIN_DOCS texts and over HOST_SHARE of a host's texts carry it;
#: a document is depleted if under KEEP_SHARE of its words remain.
MIN_DOCS, HOST_SHARE, KEEP_SHARE = 20, 0.05, 0.3


def line_key(line: bytes) -> int:
    """Signed 64-bit hash of the normalised line."""
    h = xxhash.xxh64_intdigest(b" ".join(line.lower().split()), 7)
    return h - (1 << 64) if h >> 63 else h


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    k = len(number)
    keys = [(a * k + b) * k + c for a, b, c in zip(ids, ids[1:], ids[2:], strict=False)]
    if len(set(keys)) == n:
        return 0
    seen: set[int] = set()
    again: set[int] = set()
    for x in keys:
        (again if x in seen else seen).add(x)
    count, upto = 0, 0
    for i, x in enumerate(keys):
        if x in again:
            count += i + 3 - max(upto, i)
            upto = i + 3
    return count


def measures(text: bytes) -> tuple[int, int, int, int, int, dict[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words of each distinct line."""
    words = text.split()
    bare = text.translate(None, _SPACE)
    # code points: bytes that do not continue one
    chars = len(bare.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dups = 0
    lines: dict[int, int] = {}
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            if line in seen:
                dups += 1
            seen.add(line)
            key = line_key(line)
            lines[key] = lines.get(key, 0) + n
    return len(words), chars, symbols, dups, repeated_words(words), lines


_FEATURES = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line: long, words: int>>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(5)]
        offsets, keys, counts = [0], [], []
        for t in b.column(3).cast(pa.binary()).to_pylist():
            *found, lines = measures(t or b"")
            for c, v in zip(cols, found, strict=True):
                c.append(v)
            keys.extend(lines)
            counts.extend(lines.values())
            offsets.append(len(keys))
        pairs = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int32())], ["line", "words"])
        arrays = [b.column(i) for i in range(3)] + [pa.array(c, pa.int64()) for c in cols] + [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)]
        names = ["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
        yield pa.RecordBatch.from_arrays(arrays, names)


def features(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A materialised table of the measures of every row, with the row's number rid and its lines."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    return materialize(rows.mapInArrow(tidy(_features), _FEATURES).withColumn("rid", F.monotonically_increasing_id()), "quality")


def template_lines(rows: DataFrame, *, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE) -> DataFrame:
    """(host, line): carried by over min_docs distinct texts and over host_share of the host's distinct texts.

    rows: what features() returns. Rows without a host form one host of their own.
    """
    texts = rows.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    hosts = texts.groupBy("host").agg(F.count("*").alias("texts"))
    common = texts.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    above = common.alias("c").join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")) & (F.col("c.n") > F.lit(host_share) * F.col("h.texts")))
    return above.select(F.col("c.host").alias("host"), "line")


def verdicts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, keep_share: float = KEEP_SHARE) -> tuple[DataFrame, DataFrame]:
    """One row per row of df with the measures, removed_words, base_failed and kept; and the template lines.

    A null text has no words. kept: not base_failed, and at least keep_share of the words remain once
    template lines are removed. A null host is a host of its own. Repeated rows get equal verdicts.
    """
    rows = features(df, id_col=id_col, text_col=text_col, host_col=host_col)
    lines = materialize(template_lines(rows, min_docs=min_docs, host_share=host_share), "templates")
    side = F.broadcast(lines) if small_enough(lines) else lines
    own = rows.select("rid", "host", F.explode("lines").alias("l")).select("rid", "host", "l.line", "l.words").alias("o")
    hit = own.join(side.alias("t"), (F.col("o.line") == F.col("t.line")) & F.col("o.host").eqNullSafe(F.col("t.host")))
    removed = hit.groupBy("rid").agg(F.sum("words").alias("removed_words"))
    out = rows.drop("lines").join(removed, "rid", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("removed_words")) < F.lit(keep_share) * F.col("n_words")
    return out.withColumns({"base_failed": failed, "kept": ~failed & ~depleted}), lines


def without_lines(text: bytes, gone: set[int]) -> bytes:
    return b"\n".join(x for x in text.split(b"\n") if not x.strip() or line_key(x) not in gone)


def clean(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", n_chars_col: str | None = "n_chars", min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, keep_share: float = KEEP_SHARE) -> DataFrame:
    """df's kept rows, with df's columns; template lines are gone from the texts, and n_chars_col follows them.

    Null and empty texts have no words and are rejected. A null host is a host of its own. Repeated rows are kept or
    rejected together. An empty table stays empty.
    """
    marks, lines = verdicts(df, id_col=id_col, text_col=text_col, host_col=host_col, min_docs=min_docs, host_share=host_share, keep_share=keep_share)
    small_batches(df.sparkSession)
    # a verdict depends on host and text alone, so rows are matched by them, and rejected texts are few
    gone = materialize(marks.where(~F.col("kept")).select(F.col("host").alias("__vg_host"), F.col("text_hash").alias("__vg_hash")).distinct(), "rejected")
    gone = F.broadcast(gone) if small_enough(gone) else gone
    names = df.columns
    host, hashed = F.col(f"`{host_col}`").cast("string"), F.xxhash64(F.col(f"`{text_col}`"))
    rows = df.withColumns({"__vg_h": host, "__vg_t": hashed}).join(gone, F.col("__vg_h").eqNullSafe(F.col("__vg_host")) & (F.col("__vg_t") == F.col("__vg_hash")), "left_anti")

    @F.arrow_udf("string")
    def _strip(texts: pa.Array, drop: pa.Array) -> pa.Array:
        out = []
        for t, d in zip(texts.cast(pa.binary()).to_pylist(), drop.to_pylist(), strict=True):
            out.append(t if t is None or not d else without_lines(t, set(d)))
        return pa.array(out, pa.binary()).cast(pa.string())

    # The templates of a host are at most 1 / host_share times its mean number of lines, so they fit in one row of it.
    by_host = materialize(lines.groupBy(F.col("host").alias("__vg_host")).agg(F.collect_set("line").alias("__vg_lines")), "host-lines")
    by_host = F.broadcast(by_host) if small_enough(lines, BROADCAST_ROWS) else by_host
    rows = rows.join(by_host, F.col("__vg_h").eqNullSafe(F.col("__vg_host")), "left")
    text, some = F.col(f"`{text_col}`"), F.col("__vg_lines").isNotNull()
    text = F.when(some, _strip(F.when(some, text), F.col("__vg_lines"))).otherwise(text)
    rows = rows.withColumn(text_col, text)
    if n_chars_col in names:
        rows = rows.withColumn(n_chars_col, F.length(F.col(f"`{text_col}`")).cast(df.schema[n_chars_col].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in names])
