"""SimHash near-duplicates, found by pigeonhole blocks.

Each text becomes a 64-bit fingerprint. Fingerprints, not documents, are linked: equal ones form a
class, so copies cost one row. A fingerprint is cut into ``distance + 2`` blocks; two that differ in
at most ``distance`` bits agree on two blocks at least, so they share the bucket of some pair of
blocks. Candidates are joined on buckets, and the Hamming distance is verified.

A bucket of more than ``bucket_pairs`` fingerprints would give too many pairs. Its members, which are
close to each other already, are verified by midpoints instead: for a distance of 2 at most, two
fingerprints are linked exactly if some value is within one bit of both. Each member lists itself and
its 64 one-bit neighbours, and members that list the same value are linked to the least of them.
That is exact, and a value is listed by 65 members at most.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import similar
from ._common import materialize, small_batches
from .components import connected_components

SEED = 42


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Unsigned 64 bits: bit i is 1 if it is 1 in over half of the hashes of the word shingles, repeats included.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space. Fewer words than a
    shingle's make one shingle; no words (or null) give 0.
    """
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    total = 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    for bit in np.flatnonzero(2 * counts > len(hashes)).tolist():
        total |= 1 << bit
    return total


def fingerprints(df: DataFrame, *, text_col: str = "text", words: int = 3, out_col: str = "fp") -> DataFrame:
    """df with the fingerprint as a (signed) long; a column of that name is replaced."""
    small_batches(df.sparkSession)

    @F.arrow_udf("long")
    def _fp(texts: pa.Array) -> pa.Array:
        # one run of equal texts costs one fingerprint
        out, last, value = [], None, None
        for t in texts.cast(pa.binary()).to_pylist():
            if value is None or t != last:
                last, value = t, fingerprint(t, words)
            out.append(value)
        return pa.array(np.array(out, dtype=np.uint64).view(np.int64))

    return df.withColumn(out_col, _fp(F.col(f"`{text_col}`")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(distance: int) -> list[int]:
    """Masks of two of the distance + 2 blocks; values that differ in at most distance bits agree under one of them."""
    n = distance + 2
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [_signed(x | y) for x, y in combinations(blocks, 2)]


def link_fingerprints(fps: DataFrame, distance: int = 2, bucket_pairs: int = 64) -> DataFrame:
    """Links (a, b) between the distinct longs in column ``fp``; their components are those of all pairs within the distance.

    Within small buckets every close pair is a link; in larger ones each member is linked to the least
    member at a shared midpoint, so the links stay linear in the members.
    """
    if not 0 <= distance <= 2:
        raise ValueError("midpoints verify distances up to 2")
    masks = block_masks(distance)
    banded = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("s")).select("fp", "s.band", "s.key")
    sizes = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(banded.join(sizes, ["band", "key"]), "buckets")
    few = shared.where(F.col("n") <= bucket_pairs)
    pairs = (
        few.alias("x")
        .join(few.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")))
        .where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance)
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    many = shared.where(F.col("n") > bucket_pairs).select("fp").distinct()
    reach = [0] + ([_signed(1 << i) for i in range(64)] if distance else [])
    if distance == 1:
        # the least member within one bit of a listed member, which must itself be the listed value
        listed = many.select("fp", F.explode(F.array(*[F.lit(x) for x in reach])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
        links = listed.join(many.select(F.col("fp").alias("mid")), "mid").select(F.col("fp").alias("a"), F.col("mid").alias("b")).where("a <> b")
    else:
        listed = many.select("fp", F.explode(F.array(*[F.lit(x) for x in reach])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
        links = listed.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("mid")).alias("b")).where("a <> b")
    return pairs.union(links).distinct()


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2, bucket_pairs: int = 64) -> DataFrame:
    """df's rows with fingerprint (16 hex digits) and component_id.

    component_id: the smallest id reachable over links, the row's own included; null only where all
    ids of a component are null. Null and empty
    texts have the fingerprint zero and are linked like any other; equal texts are one class whatever
    their number. An empty table gives no rows. Only the id is kept of df's other columns.
    """
    ids = fingerprints(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), text_col="text", words=words).select("doc_id", "fp")
    docs = materialize(ids, "fingerprints")
    classes = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    edges = link_fingerprints(classes.select("fp"), distance, bucket_pairs)
    nodes = connected_components(edges).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(nodes, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    tops = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = rooted.join(tops, "root").select("fp", "component_id")
    return docs.join(placed, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _representatives(df: DataFrame, id_col: str, text_col: str, words: int, distance: int) -> DataFrame:
    """(id, th) of the rows that stay."""
    order = [F.col("id").asc_nulls_last(), F.col("th")]
    text = F.col(f"`{text_col}`")
    keyed = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    docs = materialize(fingerprints(keyed, words=words).select("id", "th", "fp"), "fingerprints")
    # a class's first row: the limit on ranks runs before the exchange too, so a class of many copies sends one row a task
    first = docs.withColumn("n", F.row_number().over(Window.partitionBy("fp").orderBy(*order))).where("n = 1").drop("n")
    classes = materialize(first, "classes")
    nodes = connected_components(link_fingerprints(classes.select("fp"), distance)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(nodes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rooted.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy(*order))).where("n = 1").select("id", "th")


def keep_representatives(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, distance: int | None = None) -> DataFrame:
    """df without near duplicates: of each component the row with the smallest id stays, with all its columns.

    distance: links are fingerprints of 64 bits within it; by default links are texts of a similarity
    of 0.8, by blocks of longer fingerprints, their distance and exact similarity (see similar.py). Texts without words, null and empty
    ones too, are one class, of which one row stays. Of rows equal in id and text one stays. Rows are
    ordered by id (nulls last), then by a hash of the text. An empty table stays empty.
    """
    names = df.columns
    if distance is None:
        kept = similar.representatives(df, id_col=id_col, text_col=text_col, words=words)
    else:
        kept = _representatives(df, id_col, text_col, words, distance)
    kept = kept.select(F.col("id").alias("__vg_id"), F.col("th").alias("__vg_th"))

    # One exchange of the texts serves both steps: they share their keys, which are never null.
    def keys(i, t):
        return {"__vg_a": F.coalesce(F.col(i), F.lit(0).cast("long")), "__vg_b": F.col(i).isNull(), "__vg_c": F.col(t)}

    on = ["__vg_a", "__vg_b", "__vg_c"]
    rows = df.withColumns({"__vg_i": F.col(f"`{id_col}`").cast("long"), "__vg_t": F.xxhash64(F.col(f"`{text_col}`"))})
    rows = rows.withColumns(keys("__vg_i", "__vg_t"))
    # rows equal in id and text are repeats: one of them stays
    one = rows.withColumn("__vg_n", F.row_number().over(Window.partitionBy(*on).orderBy("__vg_t"))).where("__vg_n = 1")
    wanted = kept.withColumns(keys("__vg_id", "__vg_th")).select(*on)
    return one.join(wanted, on, "left_semi").select(*[F.col(f"`{c}`") for c in names])
