"""Near-duplicates at a similarity of 0.8: SimHash fingerprints, found by blocks, verified by Hamming distance and exact similarity.

A text is the set of its word shingles. Each shingle's hash is mixed to as many bits as the fingerprint has, and
a fingerprint bit is 1 if it is 1 in over half of them. Two sets of the Jaccard similarity 0.8 have a cosine of 8/9 at
least, so that a bit differs with a probability of FLIP at most (FLIP_SHORT for 4 and 5 shingles), and bits of unlike
sets with one half. The first CHECKED bits are compared; the others are dealt into blocks. Fingerprints that
agree in a whole block share its bucket. Blocks are so wide that a bucket holds about BUCKET unlike fingerprints, and so
many that a pair at 0.8 shares no bucket with a probability of MISSED at most: both follow from the number of rows.

Inside a bucket all fingerprints are compared, and a pair that differs in at most MOST of the CHECKED bits is a candidate.
A candidate is a link if the sets themselves, joined by their numbers, are similar enough, so no pair below SIMILAR
is ever linked. The candidates of a bucket form groups. First each member of a group is verified against the group's
least, then, in groups that still hold several components, all candidates across components: a pair inside one
component cannot change the result.

Texts with equal sets are one class. Two unlike sets of which one has under 4 shingles are never similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log1p, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, small_batches, small_enough, tidy
from .components import connected_components

#: The least Jaccard similarity of a link, as a fraction.
SIMILAR = (4, 5)
#: Chance at most that a bit of two sets of that similarity differs: the most over all sizes, of 12 and 15 shingles, and of 4 and 5.
FLIP, FLIP_SHORT = 0.1612, 0.1875
SHORT = 5
#: Chance that a pair of that similarity shares no bucket; unlike fingerprints in a bucket.
MISSED, BUCKET = 5e-5, 512
#: Words of 64 bits that are compared, and the most bits in which candidates differ: 5 standard deviations above the mean at FLIP_SHORT.
CHECKED, MOST = 3, 64


def blocks(rows: int) -> tuple[int, int, int]:
    """For so many rows the bits of a block, the blocks of a fingerprint, and those of one of at most SHORT shingles."""
    bits = max(6, ceil(log2(max(1, rows) / BUCKET)))
    few, many = (ceil(log(MISSED) / log1p(-((1 - flip) ** bits))) for flip in (FLIP, FLIP_SHORT))
    return bits, few, many


def words_of(rows: int) -> tuple[int, int]:
    """The words of 64 bits in a fingerprint, those compared and the blocks; then in one of at most SHORT shingles."""
    bits, few, many = blocks(rows)
    return CHECKED + ceil(bits * few / 64), CHECKED + ceil(bits * many / 64)


def _mixed(h: np.ndarray, length: int) -> np.ndarray:
    """``length`` well-mixed hashes of each hash, as a matrix."""
    x = h[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, length + 1, dtype=np.uint64)[None, :]
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """Hashes of a text's word shingles, each once, sorted; a text of fewer words is one shingle, one without words has none."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    n = max(1, len(tokens) - words + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(words, len(tokens)) - 1 :] - 1).tolist()
    return np.unique(np.array([digest(joined[a:b], 5) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64))


def signature(h: np.ndarray, length: int = CHECKED) -> np.ndarray:
    """A set's SimHash of ``length`` words: bit i is 1 if it is 1 in over half of the mixed hashes; all 0 for the empty set."""
    counts = np.zeros(64 * length, np.int64)
    for at in range(0, len(h), 255):
        bits = np.unpackbits(_mixed(h[at : at + 255], length).astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").view("<u8").astype(np.uint64, copy=False)


def fingerprint(text: bytes | None, words: int = 5, length: int = CHECKED) -> np.ndarray:
    """The SimHash of a text's word shingles; all 0 for a text without words."""
    return signature(shingles(text, words), length)


def block_keys(v: np.ndarray, bits: int, many: int) -> np.ndarray:
    """A key for each block of each fingerprint (rows of words): the block's number and its bits."""
    flat = np.unpackbits(np.ascontiguousarray(v[:, CHECKED:], "<u8").view(np.uint8), axis=1, bitorder="little")
    values = flat[:, : bits * many].reshape(len(v), many, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return (np.arange(many, dtype=np.int64) << 44)[None, :] + values


def similar_enough(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, arrays without repeats, have a Jaccard similarity of SIMILAR at least."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _sizes_allow(a: Column, b: Column) -> Column:
    """No two sets of sizes further apart are similar enough."""
    return SIMILAR[1] * F.least(a, b) >= SIMILAR[0] * F.greatest(a, b)


def _least_by_search(v: np.ndarray, most: int) -> np.ndarray:
    """The same for crowded buckets: each row is compared with those only that no component has yet, so close rows cost little."""
    label = np.full(len(v), -1)
    left = np.arange(len(v))
    while len(left):
        first, queue = left[0], [left[:1]]
        label[first], left = first, left[1:]
        while queue and len(left):
            for i in queue.pop():
                if not len(left):
                    break
                near = np.bitwise_count(v[left] ^ v[i]).sum(axis=1, dtype=np.int64) <= most
                if near.any():
                    label[left[near]] = first
                    queue.append(left[near])
                    left = left[~near]
    return label


def least_in_component(v: np.ndarray, most: int) -> np.ndarray:
    """For each row of v the first row of its component, under links of at most ``most`` differing bits."""
    n = len(v)
    if n > 4 * BUCKET:
        return _least_by_search(v, most)
    label = np.arange(n)
    step = max(1, (1 << 22) // max(1, n))
    while True:
        new = label.copy()
        for a in range(0, n, step):
            apart = sum(np.bitwise_count(v[a : a + step, k][:, None] ^ v[None, :, k]).astype(np.int16) for k in range(v.shape[1]))
            new[a : a + step] = np.where(apart <= most, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sets(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        bounds = column.offsets.to_numpy()
        return bounds - bounds[0], column.flatten().to_numpy()

    for b in batches:
        if not b.num_rows:
            continue
        (at, x), (to, y) = sets(b.column(2)), sets(b.column(3))
        close = pa.array([similar_enough(x[at[i] : at[i + 1]], y[to[i] : to[i + 1]]) for i in range(b.num_rows)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(close)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (node, hashes) are similar enough."""
    x, y = (sets.select(F.col("node").alias(k), F.col("hashes").alias(f"set_{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b").mapInArrow(tidy(_verify), "a long, b long")


def _apart(x: str, y: str) -> Column:
    """The differing bits of two compared fingerprints, arrays."""
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, CHECKED)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))


def buckets(classes: DataFrame, rows: int) -> DataFrame:
    """(key, node, n, checked, first): the members of each group of candidates in a bucket, with the group's least member."""
    bits, few, many = blocks(rows)
    long, short = words_of(rows)
    own = [f"w{i}" for i in range(CHECKED)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                starts, flat = b.column(2).offsets.to_numpy()[:-1], b.column(2).values.to_numpy()
                node, n = b.column(0).to_numpy(), b.column(1).to_numpy()
                for some, length, dealt in ((n > SHORT, long, few), (n <= SHORT, short, many)):
                    if some.any():
                        v = flat[starts[some][:, None] + np.arange(length)]
                        columns = (block_keys(v.view(np.uint64), bits, dealt).ravel(), *(np.repeat(c, dealt) for c in (node[some], n[some], *v[:, :CHECKED].T)))
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "n", *own])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def found(t: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(t[0])) + 1, [t.shape[1]]))
            parts = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1:
                    first = least_in_component(np.ascontiguousarray(t[3:, a:b].T).view(np.uint64), MOST)
                    some = np.flatnonzero(np.bincount(first, minlength=b - a)[first] > 1)
                    parts.append(np.concatenate((t[:, a + some], t[1:3, a + first[some]])))
            if parts:
                every = np.concatenate(parts, axis=1)
                for at in range(0, every.shape[1], 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in every[:, at : at + 8192]], ["key", "node", "n", *own, "first_node", "first_n"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.stack([c.to_numpy() for c in b.columns]))
            size += b.num_rows
            # a bucket may go on in the next batch: whole ones are done when they are many, or when one that was held has ended
            if size >= 16 * BUCKET and held[0][0, 0] != held[-1][0, -1]:
                t = np.concatenate(held, axis=1)
                end = int(np.searchsorted(t[0], t[0, -1]))
                yield from found(t[:, :end])
                held, size = [t[:, end:].copy()], t.shape[1] - end
        if held:
            yield from found(np.concatenate(held, axis=1))

    columns = ", ".join(f"{c} long" for c in ("key", "node", "n", *own))
    dealt = classes.where("n > 3").select("node", "n", "fp").mapInArrow(tidy(deal), columns)
    near = dealt.repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidy(groups), columns + ", first_node long, first_n long")
    return near.select(
        F.xxhash64("key", "first_node").alias("key"), "node", "n", F.array(*own).alias("checked"), F.struct(F.col("first_node").alias("node"), F.col("first_n").alias("n")).alias("first")
    )


def links(classes: DataFrame, texts: DataFrame, words: int, rows: int) -> DataFrame:
    """(a, b): links enough to connect every pair of candidates that is similar enough.

    classes: (id, th, node, n, fp), a materialised table, fp a fingerprint for that many rows; texts: (id, th, text).
    """
    bucket = Window.partitionBy("key")
    members = materialize(buckets(classes, rows), "buckets")

    wanted = materialize(members.select("node").distinct().join(classes, "node").select(F.col("id").alias("w_id"), F.col("th").alias("w_th"), "node"), "candidates")
    wanted = F.broadcast(wanted) if small_enough(wanted) else wanted

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, words) for t in b.column(1).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "hashes"])

    own = texts.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).select("node", "text")
    # rows equal in id and text are one class
    sets = materialize(own.mapInArrow(tidy(hashes), "node long, hashes array<long>").dropDuplicates(["node"]), "shingles")

    stars = materialize(members.where((F.col("node") != F.col("first.node")) & _sizes_allow(F.col("n"), F.col("first.n"))).select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct(), "stars-of-groups")
    found = materialize(verified(stars, sets), "links")
    labelled = members.join(connected_components(found), "node", "left").select("key", "node", "n", "checked", F.coalesce("root", "node").alias("root"))
    several = labelled.withColumns({"low": F.min("root").over(bucket), "high": F.max("root").over(bucket)}).where("low <> high")
    several = materialize(several.select("key", "node", "n", "checked", "root"), "open-groups")
    x, y = (several.select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "checked", "root")]) for k in "ab")
    across = x.join(y, "key").where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & _sizes_allow(F.col("n_a"), F.col("n_b")) & (_apart("checked_a", "checked_b") <= MOST))
    rest = across.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    return found.union(verified(rest, sets))


def representatives(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, th) of the rows that stay: of each component the one with the smallest id (nulls last), then text hash.

    Null, empty and blank texts have the empty set and are one class. Repeated rows are one row. An empty table gives none.
    """
    small_batches(df.sparkSession)
    text = F.col(f"`{text_col}`")
    count = df.count()
    lengths = words_of(count)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, words) for t in b.column(2).cast(pa.binary()).to_pylist()]
            size = np.array([len(h) for h in found], np.int64)
            digests = np.array([divmod(xxhash.xxh3_128_intdigest(h.tobytes()), 1 << 64) for h in found], np.uint64).reshape(-1, 2).view(np.int64)
            prints = [signature(h, lengths[len(h) <= SHORT]) for h in found]
            ends = np.cumsum([0, *map(len, prints)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prints).view(np.int64) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(d)) for d in digests.T), pa.array(size), lists], ["id", "th", "set_a", "set_b", "n", "fp"])

    keyed = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    docs = keyed.mapInArrow(tidy(rows), "id long, th long, set_a long, set_b long, n long, fp array<long>")
    order = [F.col("id").asc_nulls_last(), F.col("th")]
    first = docs.withColumn("k", F.row_number().over(Window.partitionBy("set_a", "set_b").orderBy(*order))).where("k = 1")
    classes = materialize(first.select("id", "th", "n", "fp", F.monotonically_increasing_id().alias("node")), "signatures")
    nodes = connected_components(links(classes, keyed, words, count))
    rooted = classes.select("id", "th", "node").join(nodes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy(*order))).where("k = 1").select("id", "th")
