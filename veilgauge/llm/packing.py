"""Packing into windows: shallow length combinations, whose repeat counts solve a non-negative least-squares problem.

Documents become token ids; whole windows are cut off, and what is left of each is a remainder. The
histogram of remainder lengths is bounded by the window, so it goes to the driver, which enumerates
combinations of two and three lengths that fill a window exactly, solves non-negative least squares
for how often each is used, rounds, and fills up greedily. Remainders that no combination takes are
packed next-fit in falling length, cut where a window ends, so that they leave no padding either.
Each remainder then finds its place from its length and its number among those of its length; no
piece is ever collected.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, small_batches, small_enough, tidy

TOKENIZER, END_ID = "word_bpe_49k.json", 1
#: Words and pre-tokens whose ids a worker remembers; beyond, it starts afresh.
CACHED_WORDS, CACHED_PARTS = 350_000, 300_000


class Encoder:
    """Ids of the named tokenizer, word by word.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its
    words. Frequent words are looked up; new ones of plain letters, digits and ASCII signs are cut
    by the tokenizer's own published pattern, and their pieces encoded together; any others go to the
    tokenizer as they are.
    """

    def __init__(self, name: str):
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if not os.path.exists(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.name = name
        # the same model for pieces that are in normal form and cut already
        self.inner = Tokenizer.from_file(name)
        self.inner.normalizer = normalizers.Sequence([])
        self.inner.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.inner.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.last = np.zeros(size, bool)  # ids that end a pre-token
        for token, i in self.inner.get_vocab(with_added_tokens=False).items():
            self.last[i] = token.endswith("</w>")
        # The tokenizer's pre-token pattern, and the characters that the quick way is for.
        self.pattern = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.odd = regex.compile(r"[^\n!-~À-ɏЀ-џ]|<\|")
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self):
        """The tokenizer as it is, for what the quick way is not for."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.name)

    def lower(self, texts: pa.Array) -> pa.Array:
        """A-Z lowered, as the tokenizer does itself, where no text may hold a special token, which is told by its case."""
        return texts if pc.any(pc.match_substring(texts, "<|")).as_py() else pc.ascii_lower(texts)

    def forget(self) -> None:
        self.words.clear()
        self.parts.clear()

    def pack(self, ids) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def _learn(self, new: list[bytes]) -> None:
        if len(self.parts) > CACHED_PARTS:
            self.parts.clear()
        text = b"\n".join(new).decode("utf-8", "replace")
        if self.odd.search(text):
            rest = []
            for w, t in zip(new, text.split("\n"), strict=True):
                if self.odd.search(t):
                    self.words[w] = self.pack(self.tokenizer.encode(t, add_special_tokens=False).ids)
                else:
                    rest.append(w)
            if rest:
                self._learn(rest)
            return
        found = self.pattern.findall(unicodedata.normalize("NFC", text).lower())
        parts = self.parts
        missing = set(found).difference(parts)
        missing.discard("\n")
        missing = list(missing)
        for at in range(0, len(missing), 5000):
            some = missing[at : at + 5000]
            ids = np.asarray(self.inner.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                for p in some:
                    parts[p] = self.pack(self.tokenizer.encode(p, add_special_tokens=False).ids)
                continue
            raw, stops = self.pack(ids), (ends * self.dtype.itemsize).tolist()
            parts.update(zip(some, [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
        parts["\n"] = b"\n"
        cuts = [i for i, p in enumerate(found) if p == "\n"]
        values = list(map(parts.__getitem__, found))
        join = b"".join
        self.words.update(zip(new, [values[a] if b - a == 1 else join(values[a:b]) for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(found)], strict=True)], strict=True))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text its ids and END_ID. Only a batch's distinct words are looked up."""
        lists = pc.ascii_split_whitespace(self.lower(texts.fill_null("")))
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        self.words[b""] = b""  # white space at an end makes an empty word
        if new := [w for w in distinct if w not in self.words]:
            self._learn(new)
        values = list(map(self.words.__getitem__, distinct))
        ids = np.frombuffer(b"".join(values), self.dtype)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        shift = (starts[at] - ends[:-1]).astype(np.int32)  # a batch has far fewer than 2**31 ids
        flat = ids[np.repeat(shift, n) + np.arange(ends[-1], dtype=np.int32)]
        cuts = ends[bounds - bounds[0]].tolist()
        end = np.array([END_ID], self.dtype)
        return [np.concatenate((flat[a:b], end)) for a, b in zip(cuts, cuts[1:], strict=False)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# --- the plan, on the driver -------------------------------------------------


def combinations_of(window: int, spread: int = 6) -> np.ndarray:
    """Rows (a, b, c), a <= b <= c, that add up to the window; a is 0 for pairs. spread: values of b for each a > 0."""
    rows = [(0, b, window - b) for b in range(1, window // 2 + 1)]
    for a in range(1, window // 3 + 1):
        last = (window - a) // 2
        rows += [(a, int(b), window - a - int(b)) for b in np.unique(np.linspace(a, last, spread).round())]
    return np.array(rows, dtype=np.int64).reshape(-1, 3)


def nnls(combos: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that about minimises |A x - counts|; A[l, j]: how often combos[j] has length l. Accelerated projected gradient."""
    n = len(counts)
    real = (combos > 0).astype(float)

    def forward(x):
        y = np.zeros(n)
        for k in range(3):
            y += np.bincount(combos[:, k], weights=x * real[:, k], minlength=n)
        return y

    def back(r):
        return sum(r[combos[:, k]] * real[:, k] for k in range(3))

    v = np.ones(len(combos))
    norm = 1.0
    for _ in range(30):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - counts))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


class Plan:
    """Where the i-th remainder of a length goes. lengths: counts[l] remainders of length l, 0 < l <= window."""

    def __init__(self, counts: np.ndarray, window: int):
        left = counts.astype(np.int64).copy()
        self.window = window
        rows: list[tuple[int, int, int, int, int, bool]] = []  # length, first number, count, sequence or position, offset, streamed
        used = np.zeros(window + 1, np.int64)
        sequence = 0

        def take(length: int, n: int, offset: int) -> None:
            rows.append((length, int(used[length]), n, sequence, offset, False))
            used[length] += n
            left[length] -= n

        if left[window]:
            n = int(left[window])
            take(window, n, 0)
            sequence += n
        combos = combinations_of(window)
        if len(combos) and left.any():
            times = nnls(combos, left.astype(float))
            order = np.argsort(-times, kind="stable")
            for rounded in (True, False):  # as solved, then greedily, long pieces first
                if not rounded:
                    order = np.lexsort((-combos[:, 1], -combos[:, 2]))
                for j in order.tolist():
                    parts = [int(x) for x in combos[j] if x]
                    need = {x: parts.count(x) for x in parts}
                    n = min(int(left[x]) // k for x, k in need.items())
                    n = min(n, int(round(times[j]))) if rounded else n
                    if n <= 0:
                        continue
                    offset = 0
                    for x in reversed(parts):
                        take(x, n, offset)
                        offset += x
                    sequence += n
        self.first_stream, position = sequence, 0
        for length in range(window, 0, -1):
            if n := int(left[length]):
                rows.append((length, int(used[length]), n, position, 0, True))
                position += n * length
        self.sequences = sequence + -(-position // window)
        rows.sort()
        self.rows = np.array(rows, dtype=np.int64).reshape(-1, 6)
        self.keys = (self.rows[:, 0] << 44) + self.rows[:, 1]

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, offset, and how much of the piece fits there (the rest starts the next sequence)."""
        at = np.searchsorted(self.keys, (length << 44) + number, side="right") - 1
        _, first, _, base, offset, streamed = self.rows[at].T
        rank = number - first
        position = base + rank * length
        sequence = np.where(streamed == 1, self.first_stream + position // self.window, base + rank)
        offset = np.where(streamed == 1, position % self.window, offset)
        return sequence, offset, np.minimum(length, self.window - offset)


# --- the data, on the executors ----------------------------------------------

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local long, ids binary"


def _cut_documents(name: str, window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        numbers = np.zeros(window + 1, np.int64)  # of the pieces of each length in this partition
        for b in batches:
            take, cols = [], [[] for _ in range(6)]
            for r, ids in enumerate(enc.encode(b.column(1))):
                wide = ids.astype("<u4")
                for start in range(0, len(ids), window):
                    n = min(window, len(ids) - start)
                    take.append(r)
                    kept = ids[start : start + n].tobytes() if n < window else None
                    for c, v in zip(cols, (start, n, zlib.crc32(wide[start : start + n]), len(ids), int(numbers[n]), kept), strict=True):
                        c.append(v)
                    numbers[n] += 1
            at = pa.array(take, pa.int64())
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "local", "ids"])
        enc.forget()  # a worker outlives its task; what it knows must not fill an executor that goes on to other work

    return cut


def pack(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: a file of the tokenizers library, or the name of one of the public ones. A document is
    its ids and END_ID; a null or empty text has END_ID alone. Sequences hold at most window ids, all
    but the last exactly that many. Repeated rows and null ids are documents like others: each is
    packed. An empty table gives no rows. Other columns are not kept.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    cut = docs.mapInArrow(tidy(_cut_documents(tokenizer, window)), _PIECES).withColumn("pid", F.monotonically_increasing_id())
    pieces = materialize(cut.withColumn("part", F.shiftright("pid", 33)), "pieces")
    # the number of a piece among those of its length: those of earlier partitions, and those before it in its own
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    hist = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # window rows at most
        hist[length] = n
    plan = Plan(hist, window)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    starts = F.broadcast(starts) if small_enough(counts) else starts

    @F.arrow_udf("struct<sequence_id: long, offset: long, fits: long>")
    def _place(length: pa.Array, number: pa.Array) -> pa.Array:
        found = plan.place(length.to_numpy(zero_copy_only=False), number.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["sequence_id", "offset", "fits"])

    numbered = pieces.drop("ids").join(starts, ["part", "length"]).withColumn("p", _place("length", F.col("base") + F.col("local")))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = materialize(numbered.select("pid", *names, "p.sequence_id", "p.offset", "p.fits"), "placed")
    whole = placed.where("fits = length").select(*names, "sequence_id", "offset")
    halved = materialize(placed.where("fits < length"), "halved")
    ids = pieces.select("pid", "ids")
    halves = ids.join(F.broadcast(halved) if small_enough(halved) else halved, "pid")
    dtype = "<u2" if encoder(tokenizer).dtype.itemsize == 2 else "<u4"

    def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                both = np.frombuffer(r["ids"], dtype)
                k = r["fits"]
                same = {"doc_id": r["doc_id"], "doc_tokens": r["doc_tokens"]}
                out.append(same | {"start": r["start"], "length": k, "ids_crc32": ids_crc32(both[:k]), "sequence_id": r["sequence_id"], "offset": r["offset"]})
                out.append(same | {"start": r["start"] + k, "length": len(both) - k, "ids_crc32": ids_crc32(both[k:]), "sequence_id": r["sequence_id"] + 1, "offset": 0})
            kind = pa.schema([(c, pa.int64()) for c in [*names, "sequence_id", "offset"]])
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return whole.unionByName(halves.mapInArrow(tidy(_split), ", ".join(f"{c} long" for c in [*names, "sequence_id", "offset"])))
