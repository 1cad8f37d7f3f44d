"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue.

Equal vectors are one class, which keeps its smallest ids only, as many as an answer can hold; copies
cost nothing. Trees are grown on a bounded sample of classes (a hash decides which): a node splits its
sample at the median of a random projection. Every class is then put into its leaf of every tree.

A query walks all trees at once: one queue holds the open nodes of the whole forest, by the least
margin between the query and the planes on the way, and leaves are taken from it until they hold
enough rows. How many are enough is measured: queries of the sample are walked to the end, and the
share of rows is taken at which ``recall`` of their true neighbours have been met. Where vectors have
no structure to find, that share is large, and rightly so.

Query classes go in blocks of bounded size. A block is sent to all tasks with the list, for each leaf, of
the queries whose walks took it. A task sorts its classes by leaf, tree after tree, and multiplies a leaf's
classes with that leaf's queries only; pairs are never written or exchanged, each task returns the best
few of each query. Of these the exact cosine of the original vectors decides.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, small_batches, tidy

TREES, LEAF_ROWS, SAMPLE_ROWS, RECALL, BLOCK_QUERIES = 24, 64, 40_000, 0.98, 4_096
#: Classes that a task sorts by leaf at a time.
CHUNK_ROWS = 16_384
#: Queries of the sample that are walked to the end.
MEASURED = 100


@dataclass
class Tree:
    """planes[i], cuts[i] of inner node i; its children, of which x >= 0 is a node and x < 0 the leaf -x - 1."""

    planes: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.planes) else np.full(len(x), -1)
        while (open_ := at >= 0).any():
            node = at[open_]
            side = np.einsum("ij,ij->i", x[open_], self.planes[node]) >= self.cuts[node]
            at[open_] = self.children[node, side.astype(np.int64)]
        return -at - 1


def grow(x: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Tree:
    """A tree over the unit vectors x. A node whose sample no plane parts is a leaf."""
    planes, cuts, children, leaves = [], [], [], 0

    def add(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf_rows:
            for _ in range(3):
                a, b = x[rows[rng.integers(len(rows), size=2)]]
                plane = a - b + 0.3 * rng.standard_normal(x.shape[1]) / np.sqrt(x.shape[1])
                plane /= np.linalg.norm(plane) or 1.0
                along = x[rows] @ plane
                cut = float(np.median(along))
                right = along >= cut
                if 0.1 < right.mean() < 0.9:
                    i = len(planes)
                    planes.append(plane)
                    cuts.append(cut)
                    children.append([0, 0])
                    children[i] = [add(rows[~right]), add(rows[right])]
                    return i
        leaves += 1
        return -leaves

    add(np.arange(len(x)))
    return Tree(np.array(planes).reshape(-1, x.shape[1]), np.array(cuts), np.array(children, dtype=np.int64).reshape(-1, 2), leaves)


def walk(forest: list[Tree], x: np.ndarray) -> Iterator[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue."""
    queue = [(0.0, t, 0 if len(tree.planes) else -1) for t, tree in enumerate(forest)]
    along = [tree.planes @ x - tree.cuts for tree in forest]
    while queue:
        margin, t, node = heapq.heappop(queue)
        while node >= 0:
            d = along[t][node]
            near = int(d >= 0)
            heapq.heappush(queue, (max(margin, abs(float(d))), t, int(forest[t].children[node, 1 - near])))
            node = int(forest[t].children[node, near])
        yield t, -node - 1


def probe_share(forest: list[Tree], x: np.ndarray, k: int, recall: float, measured: int = MEASURED) -> float:
    """Rows that leaves must hold, as a share of all rows (one tree's), so that walks meet the recall's part of true neighbours in x."""
    n = len(x)
    if n <= k + 1:
        return float(len(forest))
    leaves = [tree.leaf_of(x) for tree in forest]
    sizes = [np.bincount(leaf, minlength=max(1, tree.leaves)) for leaf, tree in zip(leaves, forest, strict=True)]
    needed = []
    for q in range(min(measured, n)):
        near = x @ x[q]
        near[q] = -2
        true = np.argpartition(-near, k)[:k]
        goal = [{int(leaf[i]) for i in true} for leaf in leaves]
        open_ = set(true.tolist())
        held = 0
        for t, leaf in walk(forest, x[q]):
            held += int(sizes[t][leaf])
            if leaf in goal[t]:
                met = {i for i in open_ if leaves[t][i] == leaf}
                needed += [held] * len(met)
                open_ -= met
                if not open_:
                    break
    return float(np.quantile(needed, recall, method="higher")) / n


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length, without nulls, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Search:
    """The best few classes of each of a block's queries, of the classes added so far.

    members[first[leaf]:first[leaf + 1]]: the numbers of the queries whose walk took the leaf. products
    counts the multiplications of vectors.
    """

    def __init__(self, queries: np.ndarray, first: np.ndarray, members: np.ndarray, keep: int):
        self.queries, self.first, self.members, self.keep = _unit(queries), first, members, keep
        self.least = np.full(len(queries), -np.inf)
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.products = 0

    def add(self, cid: np.ndarray, y: np.ndarray, leaves: np.ndarray) -> None:
        """leaves: of each row of y, one for each tree."""
        y = _unit(y)
        for own in leaves.T:
            order = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.diff(own[order], prepend=-1, append=-1))
            found = [self.best]
            for a, b in zip(cuts, cuts[1:], strict=False):
                leaf = own[order[a]]
                asked = self.members[self.first[leaf] : self.first[leaf + 1]]
                if not len(asked):
                    continue
                rows = order[a:b]
                score = self.queries[asked] @ y[rows].T
                self.products += score.size
                i, j = np.nonzero(score >= self.least[asked][:, None])
                found.append((asked[i], cid[rows[j]], score[i, j]))
            self._merge(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def _merge(self, query: np.ndarray, cid: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((cid, query))
        query, cid, score = query[order], cid[order], score[order]
        once = np.ones(len(query), bool)
        once[1:] = (query[1:] != query[:-1]) | (cid[1:] != cid[:-1])
        query, cid, score = query[once], cid[once], score[once]
        order = np.lexsort((cid, -score.round(12), query))
        query, cid, score = query[order], cid[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        # what ties with the last of the kept may have the smaller id
        last = rank == self.keep - 1
        self.least[query[last]] = score[last] - 1e-9
        kept = rank < self.keep
        self.best = (query[kept], cid[kept], score[kept])


def by_leaf(leaves: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, members) as Search takes them, of the leaves of each query's walk."""
    leaf = np.concatenate([np.zeros(0, np.int64), *leaves]).astype(np.int64)
    query = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
    return np.concatenate(([0], np.cumsum(np.bincount(leaf, minlength=n)))), query[np.argsort(leaf, kind="stable")].astype(np.int32)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks()


def exact_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows, taken in extended precision and rounded once, so that exact ties are ties."""
    x, y = x.astype(np.longdouble), y.astype(np.longdouble)
    return ((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))).astype(np.float64)


def usable(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int | None = None) -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, finite, not zero, of the dimension, with an id.

    dimension: by default the most frequent one (of equals the smallest).
    """
    v = F.col("v")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(F.coalesce(fine, F.lit(False)))
    if dimension is None:
        top = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
        dimension = top["d"] if top else 0
    return rows.where(F.size(v) == dimension)


def nearest(
    df: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 50,
    k: int = 5,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    recall: float = RECALL,
    block_queries: int = BLOCK_QUERIES,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by every, against all other rows.

    score: the cosine in double precision; ties go to the smaller id. Vectors that usable() leaves out
    take no part. Rows with one id and equal vectors are one row. recall: of true neighbours in the
    sample, that the walks are made long enough for; 1 walks until all of them were met. An empty
    table gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = materialize(usable(df, id_col=id_col, vector_col=vector_col).dropDuplicates(["vec_id", "v"]), "vectors")
    # A class keeps its k + 1 smallest ids: one may be the query's own. The rank limit also runs before the exchange.
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = materialize(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.element_at("ids", 1)), "classes")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).join(classes.select("v", "cid"), "v").select(F.col("vec_id").alias("query_id"), "cid")
    asked = materialize(asked, "queries")
    result = "query_id long, rank int, vec_id long, score double"
    sample = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample_rows).select("v").toArrow()["v"]
    if not len(sample):
        return spark.createDataFrame([], result)
    x = _unit(_matrix(sample.combine_chunks() if isinstance(sample, pa.ChunkedArray) else sample))
    forest = [grow(x, leaf_rows, np.random.default_rng([seed, t])) for t in range(trees)]
    share = probe_share(forest, x, k, recall)
    first_leaf = np.concatenate([[0], np.cumsum([max(1, tree.leaves) for tree in forest])])
    model = spark.sparkContext.broadcast((forest, first_leaf))  # at most trees * 2 * sample_rows / leaf_rows planes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, start = model.value
        for b in batches:
            y = _unit(_matrix(b.column(1))) if b.num_rows else np.zeros((0, x.shape[1]))
            at = np.stack([start[t] + tree.leaf_of(y) for t, tree in enumerate(forest)], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, len(forest), dtype=np.int32)), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["cid", "v", "leaves"])

    index = materialize(classes.select("cid", "v").mapInArrow(tidy(place), "cid long, v array<double>, leaves array<int>"), "forest")
    sizes = np.zeros(first_leaf[-1], np.int64)
    for leaf, n in index.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # as many rows as leaves
        sizes[leaf] = n
    enough = share * index.count()
    held = spark.sparkContext.broadcast(sizes)

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, start = model.value
        for b in batches:
            out = []
            for y in _unit(_matrix(b.column(1))) if b.num_rows else []:
                taken, got = [], 0
                for t, leaf in walk(forest, y):
                    at = int(start[t]) + leaf
                    taken.append(at)
                    got += int(held.value[at])
                    if got >= enough:
                        break
                out.append(taken)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], ["cid", "v", "taken"])

    wanted = classes.join(asked.select("cid").distinct(), "cid").select("cid", "v")
    walked = materialize(wanted.repartition(F.xxhash64("cid")).mapInArrow(tidy(walks), "cid long, v array<double>, taken array<int>"), "walks")
    blocks = max(1, -(-walked.count() // block_queries))
    keep = 2 * (k + 1)
    tops = []
    for block in range(blocks):
        own = walked.where(F.pmod(F.xxhash64("cid"), F.lit(blocks)) == block).toArrow().combine_chunks()
        qids, taken = own["cid"].to_numpy(), [np.array(x, np.int64) for x in own["taken"].to_pylist()]
        q = _matrix(own["v"].combine_chunks())
        queries = spark.sparkContext.broadcast((qids, q, *by_leaf(taken, len(sizes))))

        def rerank(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            qids, q, first, members = queries.value
            if not len(qids):
                return
            search = Search(q, first, members, keep)
            for rows in _chunks(batches, CHUNK_ROWS):
                search.add(rows["cid"].to_numpy(), _matrix(rows["v"].combine_chunks()), rows["leaves"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1))
            query, cid, score = search.best
            yield pa.RecordBatch.from_arrays([pa.array(qids[query]), pa.array(cid), pa.array(score)], ["qid", "cid", "score"])

        scored = index.mapInArrow(tidy(rerank), "qid long, cid long, score double")
        order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "cid")
        tops.append(materialize(scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).drop("n", "score"), "reranked"))
    found = tops[0]
    for top in tops[1:]:
        found = found.unionByName(top)

    @F.arrow_udf("double")
    def _cosine(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(exact_cosine(_matrix(x), _matrix(y)) if len(x) else np.zeros(0))

    both = found.join(classes.select("cid", "v", "ids"), "cid").join(wanted.select(F.col("cid").alias("qid"), F.col("v").alias("q")), "qid")
    ids = both.withColumn("score", _cosine("q", "v")).select("qid", "score", F.explode("ids").alias("vec_id"))
    # k + 1 ids for each query class, then for each query without its own
    several = ids.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    each = asked.join(several, asked["cid"] == several["qid"]).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
