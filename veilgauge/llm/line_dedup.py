"""Line dedup: winnowing over hashes of word runs, and removal of later repeated runs.

At each word a gram of ``gram_words`` words starts. Of the grams of a run of ``min_words`` words the one
with the least hash is the run's fingerprint (the last of equals), so equal runs have equal fingerprints.
Neighbouring runs share theirs: a fingerprint stands for a stretch of the text, its context.

Fingerprints are joined by their grams. A context that stands in an earlier text is repeated whole. Where
a gram has several contexts, a passage begins or ends inside them: there, and only there, the runs
themselves are hashed and joined, which extends the match both ways, word by word. So exactly the words
of all passages of ``min_words`` words or more that stand in full somewhere earlier, in one text, in the
order of (id, hash of the text, position), are found, and are deleted. The first occurrence does not go.

Before every exchange a batch settles what its own rows tell: of equal contexts, and of equal runs, one
row is sent, so that a passage of very many texts is few rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import key_bitmap, materialize, maybe_among, small_batches, tidy

GRAM_WORDS, MIN_WORDS = 10, 25
_SPACE = re.compile(rb"[ \t-\r]")
#: Bytes and words that are hashed at a time, to stay in a core's cache.
_BYTES, _WORDS = 1 << 17, 1 << 15
_ODD, _ODDER = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG_WORD = 64
_PLACE_BITS = 18
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
#: What is known of a context: it is sent alone, it is sent for several, it stands in an earlier text, its runs
#: are to be compared, its text repeats it.
ALONE, SEVERAL, COVERED, OPEN, AGAIN = range(5)


def minima(hashes: list[int], window: int) -> list[int]:
    """Positions of the least hash, the last of equals, in each window (in all of them, if there are fewer)."""
    chosen: list[int] = []
    last = -1
    for a in range(max(1, len(hashes) - window + 1) if hashes else 0):
        some = hashes[a : a + window]
        best = a + len(some) - 1 - some[::-1].index(min(some))
        if best != last:
            chosen.append(best)
            last = best
    return chosen


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(32)
    x *= _ODDER
    x ^= x >> np.uint64(29)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_ODD, 2 * _WORDS), _powers(pow(_ODD, -1, 1 << 64), 2 * _WORDS)


def _sums(v: np.ndarray) -> np.ndarray:
    """Running sums s of a polynomial: (s[b] - s[a]) * _DOWN[a] is the same wherever v[a:b] stands."""
    out = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v * _UP[: len(v)], out=out[1:])
    return out


def word_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the words [^\\x20\\x09-\\x0D]+ of bytes."""
    word = np.zeros(len(data) + 2, bool)
    np.greater(data - np.uint8(9), 4, out=word[1:-1])
    word[1:-1] &= data != 32
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def word_hashes(low: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of bytes in lower case, of which the last 8 are white space."""
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    data, at, n = np.frombuffer(low, np.uint8), 0, len(low) - 8
    while at < n:
        cut = _SPACE.search(low, at + _BYTES) if at + _BYTES < n else None
        stop = cut.start() if cut else n
        s, e = word_starts(data[at:stop])
        head = np.ndarray(stop - at + 1, "<u8", low, at, (1,))  # the 8 bytes at every place
        size = e - s
        h = (head[s] & _HEAD[np.minimum(size, 8)]) * np.uint64(_ODD)
        more, k = np.flatnonzero(size > 8), 8
        while len(more) and k < _LONG_WORD:
            x = h[more]
            x ^= x >> np.uint64(31)
            x += head[s[more] + k] & _HEAD[np.minimum(size[more] - k, 8)]
            x *= np.uint64(_ODD)
            h[more] = x
            k += 8
            more = more[size[more] > k]
        for i in more.tolist():
            h[i] = xxhash.xxh64_intdigest(low[at + s[i] : at + e[i]], 11)
        h += size.astype(np.uint64) * _ODDER
        starts.append(s + at)
        hashes.append(_mixed(h))
        at = stop
    return np.concatenate(starts), np.concatenate(hashes)


@dataclass
class Contexts:
    """Fingerprints of a batch in order: the text, the first and last run that a fingerprint stands for, its place, gram and context."""

    text: np.ndarray
    low: np.ndarray
    high: np.ndarray
    place: np.ndarray
    gram: np.ndarray
    context: np.ndarray


class Batch:
    """Texts as words: their hashes, and the number of the first word of each text."""

    def __init__(self, texts: pa.Array):
        raw = texts.cast(pa.binary()).fill_null(b"").to_pylist()
        starts, self.words = word_hashes(b" ".join([*raw, b" " * 8]).lower())
        ends = np.cumsum([0, *(len(t) + 1 for t in raw)])
        self.first = np.searchsorted(starts, ends)

    def contexts(self, gram_words: int, min_words: int) -> Contexts:
        n = len(self.words)
        count = np.diff(self.first)
        text = np.repeat(np.arange(len(count)), count)
        end = np.repeat(self.first[1:], count)
        window = min_words - gram_words + 1
        found: list[tuple] = []
        for at in range(0, n, _WORDS):
            v = self.words[at : at + _WORDS + min_words - 1]
            runs = len(v) - min_words + 1
            if runs <= 0:
                break
            s = _sums(v)
            gram = _mixed((s[gram_words:] - s[:-gram_words]) * _DOWN[: len(v) - gram_words + 1])
            # the place in the low bits: the last of equals is the least, and is known by its value
            best = gram & ~_PLACE | _PLACE - np.arange(len(gram), dtype=np.uint64)
            done = 1
            while done < window:
                step = min(done, window - done)
                best = np.minimum(best[:-step], best[step:])
                done += step
            run = np.flatnonzero(end[at : at + runs] - np.arange(at, at + runs) >= min_words)
            if not len(run):
                continue
            place = int(_PLACE) - (best[run] & _PLACE).astype(np.int64)
            new = np.flatnonzero(np.diff(place, prepend=-1))
            low, high, place = run[new], run[np.append(new[1:] - 1, len(run) - 1)], place[new]
            own = (s[high + min_words] - s[low]) * _DOWN[low] + (place - low + 1).astype(np.uint64) * _ODDER
            found.append((text[low + at], low + at, high + at, place + at, gram[place].view(np.int64), _mixed(_mixed(own)).view(np.int64)))
        return Contexts(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else Contexts(*[np.zeros(0, np.int64)] * 6)

    def run_hashes(self, at: np.ndarray, min_words: int) -> np.ndarray:
        """Hashes of the runs that start at the words ``at``, ascending."""
        out = np.zeros(len(at), np.uint64)
        for a in range(0, len(self.words), _WORDS):
            i, j = np.searchsorted(at, [a, a + _WORDS])
            if i < j:
                s = _sums(self.words[a : a + _WORDS + min_words])
                x = at[i:j] - a
                out[i:j] = (s[x + min_words] - s[x]) * _DOWN[x]
        return _mixed(_mixed(out)).view(np.int64)


def _ranks(b: pa.RecordBatch) -> np.ndarray:
    """The place of each row's document, (id, th) with null ids last, among those of the batch; equal ones have one."""
    null = b.column(0).is_null().to_numpy(zero_copy_only=False)
    key, th = b.column(0).fill_null(0).to_numpy(), b.column(1).to_numpy()
    order = np.lexsort((th, key, null))
    new = (np.diff(key[order], prepend=0) != 0) | (np.diff(th[order], prepend=0) != 0) | (np.diff(null[order].astype(int), prepend=0) != 0)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns is the first of its kind."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _context_rows(gram_words: int, min_words: int):
    """(id, th, gram, context, state) of the contexts of each batch; of equal ones the first is sent, what is known of the others goes with them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = Batch(b.column(2)).contexts(gram_words, min_words)
            rank = _ranks(b)[c.text]
            # by context, document and place: what a text repeats itself
            order = np.lexsort((c.place, rank, c.context))
            context, doc, place = c.context[order], rank[order], c.place[order]
            first = _starts(context, doc)
            lead = np.flatnonzero(first)
            apart = place - place[lead][np.cumsum(first) - 1]
            own = c.text[order] == c.text[order][lead][np.cumsum(first) - 1]  # a repeated row tells nothing
            inner = own & (apart >= min_words)
            overlapped = own & (apart > 0) & (apart < min_words)
            again, touching = (np.unique((np.cumsum(first) - 1)[x]) for x in (inner, overlapped))
            at = order[lead]
            # by gram: the first document of each context is sent, once for a gram
            leader = _starts(context[lead])
            later = at[~leader]
            head = at[leader]
            head = head[np.lexsort((c.context[head], c.gram[head]))]
            gram = c.gram[head]
            top = _starts(gram)
            several = np.bincount(np.cumsum(top) - 1) > 1
            parts = [
                (head[top], np.where(several, SEVERAL, ALONE)),
                (head[~top], np.full((~top).sum(), OPEN)),
                (later, np.full(len(later), COVERED)),
                (at[touching], np.full(len(touching), OPEN)),
                (at[again], np.full(len(again), AGAIN)),
            ]
            i = np.concatenate([p[0] for p in parts])
            take = pa.array(c.text[i])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(c.gram[i]), pa.array(c.context[i]), pa.array(np.concatenate([p[1] for p in parts]).astype(np.int8))],
                ["id", "th", "gram", "context", "state"],
            )

    return rows


def _joined(texts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of a batch's words, joined where they touch inside a text."""
    if not len(starts):
        return texts, starts, ends
    order = np.lexsort((starts, texts))
    texts, starts, ends = texts[order], starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] > ends[:-1]) | (texts[1:] != texts[:-1])
    at = np.flatnonzero(new)
    return texts[at], starts[at], ends[np.append(at[1:] - 1, len(ends) - 1)]


def _member(b: pa.RecordBatch, column: int, c: Contexts) -> np.ndarray:
    """Whether a context is in its own text's list."""
    lists = b.column(column)
    bounds = lists.offsets.to_numpy()
    listed = lists.flatten().to_numpy()
    owner = np.repeat(np.arange(len(lists)), np.diff(bounds))
    key = lambda text, context: _mixed(context.view(np.uint64) + text.astype(np.uint64) * np.uint64(_ODD))
    return np.isin(key(c.text, c.context), key(owner, listed))


def _run_rows(gram_words: int, min_words: int):
    """(id, th, pos, span, run): stretches that are repeated, with their words (span), and runs to be compared (span 0)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = Batch(b.column(2))
            c = words.contexts(gram_words, min_words)
            covered, opened = _member(b, 3, c), _member(b, 4, c)
            order = np.lexsort((c.place, c.text, c.context))
            first = _starts(c.context[order], c.text[order])
            apart = np.empty(len(order), np.int64)
            apart[order] = c.place[order] - c.place[order][np.flatnonzero(first)][np.cumsum(first) - 1]
            covered |= apart >= min_words
            opened &= ~covered
            # the runs of open contexts; a batch's first of equals is sent
            n = (c.high - c.low + 1)[opened]
            at = np.repeat(c.low[opened], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            text = np.repeat(c.text[opened], n)
            run = words.run_hashes(at, min_words)
            rank = _ranks(b)[text]
            order = np.lexsort((at, rank, run))
            at, text, run, rank = at[order], text[order], run[order], rank[order]
            first = _starts(run)
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            known = (rank != rank[lead]) | ((text == text[lead]) & (at - at[lead] >= min_words))
            spans = _joined(np.concatenate([c.text[covered], text[known]]), np.concatenate([c.low[covered], at[known]]), np.concatenate([c.high[covered], at[known]]) + min_words)
            open_ = ~known
            texts = np.concatenate([spans[0], text[open_]])
            starts = np.concatenate([spans[1], at[open_]]) - words.first[texts]
            size = np.concatenate([spans[2] - spans[1], np.zeros(open_.sum(), np.int64)])
            runs = np.concatenate([np.zeros(len(spans[0]), np.int64), run[open_]])
            take = pa.array(texts)
            cols = [b.column(0).take(take), b.column(1).take(take), pa.array(starts.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(runs)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "th", "pos", "span", "run"])

    return rows


def repeated_stretches(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, found): for each text with repeated runs, the stretches (pos, span) of words that they cover."""
    small_batches(df.sparkSession)
    keyed = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("text"))
    contexts = keyed.mapInArrow(tidy(_context_rows(gram_words, min_words)), "id long, th long, gram long, context long, state byte")
    # what is settled passes by, under a group of its own
    sent = F.col("state") <= SEVERAL
    group = [sent.alias("sent"), "gram"]
    doc = F.struct(F.col("id").isNull().alias("n"), "id", "th")
    one, all_ = Window.partitionBy("sent", "gram", "context"), Window.partitionBy("sent", "gram")
    compared = contexts.select("id", "th", "context", "state", *group).withColumn("first", F.min(doc).over(one))
    compared = compared.withColumns({"several": (F.min("context").over(all_) != F.max("context").over(all_)) | (F.max("state").over(all_) == SEVERAL)})
    mine = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    now = F.when(~F.col("sent"), F.col("state")).when(~mine, COVERED).when(F.col("several"), OPEN)
    told = compared.select("id", "th", "context", now.alias("state")).where("state IS NOT NULL")
    pick = lambda s: F.collect_set(F.when(F.col("state") == s, F.col("context")))
    lists = told.groupBy("id", "th").agg(pick(COVERED).alias("covered"), pick(OPEN).alias("open")).select(F.col("id").alias("l_id"), F.col("th").alias("l_th"), "covered", "open")
    lists = materialize(lists, "contexts")
    # only texts that have a list are exchanged for it
    asked = maybe_among(keyed, F.xxhash64("id", "th"), key_bitmap(lists, F.xxhash64("l_id", "l_th")), "asked").where("asked")
    own = asked.join(lists, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("th") == F.col("l_th"))).select("id", "th", "text", "covered", "open")
    rows = materialize(own.mapInArrow(tidy(_run_rows(gram_words, min_words)), "id long, th long, pos int, span int, run long"), "runs")
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "th", "pos")).over(Window.partitionBy("run"))
    runs = rows.where("span = 0").withColumn("f", first)
    same = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("th") == F.col("f.th"))
    # in the text of the first occurrence, a run that overlaps it would take a part of it
    hits = runs.where(~same | (F.col("pos") >= F.col("f.pos") + min_words)).select("id", "th", "pos", F.lit(min_words).alias("span"))
    return rows.where("span > 0").drop("run").union(hits).groupBy("id", "th").agg(F.collect_set(F.struct("pos", "span")).alias("found"))


def byte_cuts(text: bytes, stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte bounds of stretches of words, joined where they touch, with the white space after them."""
    starts, _ = word_starts(np.frombuffer(text, np.uint8))
    bounds = np.append(starts, len(text))
    joined: list[list[int]] = []
    for pos, span in sorted(stretches):
        if joined and pos <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], pos + span)
        else:
            joined.append([pos, pos + span])
    return [(int(bounds[a]), int(bounds[b])) for a, b in joined]


def without(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in cuts:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def line_dedup(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_chars_col: str | None = "n_chars",
    gram_words: int = GRAM_WORDS,
    min_words: int = MIN_WORDS,
    report: bool = False,
) -> DataFrame:
    """df with later repeated runs deleted from its texts; all rows and columns stay, n_chars_col follows the text.

    A text may become empty, as that of an exact copy does; what is left of it is not trimmed. Null
    texts stay null. Rows equal in id and text are one text: they get the same result, and one does
    not repeat the other. Nulls among ids come last in the order. An empty table has no rows. With
    report, the columns removed_runs (int) and removed_chars (long) are added, or replaced.
    """
    if not 1 <= gram_words <= min_words < _WORDS:
        raise ValueError("a gram must fit into a run")
    found = repeated_stretches(df, id_col=id_col, text_col=text_col, gram_words=gram_words, min_words=min_words)
    found = materialize(found.select(F.col("id").alias("__vg_id"), F.col("th").alias("__vg_th"), F.col("found").alias("__vg_found")), "stretches")
    rows = df.withColumns({"__vg_i": F.col(f"`{id_col}`").cast("long"), "__vg_t": F.xxhash64(F.col(f"`{text_col}`"))})
    rows = maybe_among(rows, F.xxhash64("__vg_i", "__vg_t"), key_bitmap(found, F.xxhash64("__vg_id", "__vg_th")), "__vg_asked")
    asked = rows.where("__vg_asked").join(found, F.col("__vg_i").eqNullSafe(F.col("__vg_id")) & (F.col("__vg_t") == F.col("__vg_th")), "left")
    rest = rows.where("NOT __vg_asked").withColumn("__vg_found", F.lit(None).cast(found.schema["__vg_found"].dataType))
    # texts that nothing is cut from are not exchanged
    rows = asked.drop("__vg_id", "__vg_th").union(rest)

    @F.arrow_udf("struct<text: string, runs: int>")
    def _cut(texts: pa.Array, founds: pa.Array) -> pa.Array:
        out, runs = [], []
        for t, f in zip(texts.cast(pa.binary()).to_pylist(), founds, strict=True):
            cuts = byte_cuts(t, list(zip(*(x.to_pylist() for x in f.values.flatten()), strict=True))) if t and f.is_valid else []
            out.append(without(t, cuts) if cuts else t)
            runs.append(len(cuts))
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(runs, pa.int32())], ["text", "runs"])

    text = F.col(f"`{text_col}`")
    # Only texts with repeats go through Python.
    again = F.col("__vg_found").isNotNull()
    rows = rows.withColumn("__vg_c", _cut(F.when(again, text), F.col("__vg_found")))
    rows = rows.withColumns({"__vg_gone": F.when(again, F.length(text) - F.length("__vg_c.text")).otherwise(0), "__vg_runs": F.when(again, F.col("__vg_c.runs")).otherwise(0)})
    out = rows.withColumn(text_col, F.when(again, F.col("__vg_c.text")).otherwise(text))
    names = list(df.columns)
    if n_chars_col in names:
        kind = df.schema[n_chars_col].dataType
        out = out.withColumn(n_chars_col, F.when(F.col("__vg_runs") > 0, F.length(text).cast(kind)).otherwise(F.col(f"`{n_chars_col}`")))
    if report:
        out = out.withColumns({"removed_runs": F.col("__vg_runs"), "removed_chars": F.col("__vg_gone").cast("long")})
        names += [c for c in ("removed_runs", "removed_chars") if c not in names]
    return out.select(*[F.col(f"`{c}`") for c in names])
