"""Operator 6: exact top-k by inner product, with a ball tree for each shard of the vectors. Queries are the rows whose id is divisible by ``EVERY``, against all rows.

Shards are made by the hash of the id and stored with their ball trees (splits at the median along the widest direction, leaves of 128 vectors), which are built once. A node's upper bound is q.c + |q| r;
a node is entered only by queries whose bound reaches their current k-th score, the leaves are visited by falling bound, first each query's best, and every leaf raises the k-th score for those to come, also in the
next shards of the task. Across tasks the k-th scores are shared in two passes: the first searches one shard of ``SEEDS``, and what it found is what the second has to beat. Bounds and products of all queries
of a block are computed together.

The order is by (score rounded to 6 digits, descending; id, ascending), so that ties are decided. Nothing is approximate: products in single precision only choose what is computed again
in double precision, with a margin above their error.

Scale: the vectors are shuffled once, to make the shards, and never again. Queries go out in chunks of ``CHUNK_BYTES`` (each a broadcast of that size, searched by all tasks and written, one after the other), so that a task holds a chunk and a shard.
A task sends only what may be among a query's k best; the k best of each query are chosen by a window that limits the rows of each task before its shuffle.

Defined cases: a null or empty vector, or one with a null, NaN or infinite element or one of 1e150 or more, or a null id (or one that is no whole number) is neither query nor answer; vectors answer queries of their own length only; of
rows with one id the least vector counts; a vector isn't its own answer; fewer than k others give fewer rows; an empty table gives none; further columns are ignored, whatever their names.

Result: query_id, rank (from 1), neighbor_id, score.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

K = 10
EVERY = 50
SHARD = 4096
SEEDS = 16
LEAF = 128
CHUNK_BYTES = 32 << 20
BLOCK = 4096  # queries whose bounds are computed together
DIGITS = 6
NONE = np.iinfo(np.int64).max


class Tree:
    """A ball tree: vectors in the order of the leaves; nodes with centre, radius, parent, and range."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order, nodes, todo = np.arange(len(ids)), [], [(0, len(ids), -1)]
        while todo:
            a, b, parent = todo.pop()
            part = vectors[order[a:b]]
            centre = part.mean(0)
            nodes.append((centre, np.sqrt(np.square(part - centre).sum(1).max()), parent, a, b, b - a <= LEAF))
            if b - a > LEAF:
                far = part[np.square(part - centre).sum(1).argmax()] - centre  # split along the direction of the farthest vector
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part @ far, half)]
                todo += [(a, a + half, len(nodes) - 1), (a + half, b, len(nodes) - 1)]
        self.ids, self.vectors, self.single = ids[order], vectors[order], vectors[order].astype(np.float32)
        self.centres, self.radii = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        self.sizes = np.sqrt(np.square(self.centres).sum(1))
        self.parents, self.begins, self.ends = (np.array([n[i] for n in nodes]) for i in (2, 3, 4))
        self.leaves = np.flatnonzero([n[5] for n in nodes])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "single"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.single = self.vectors.astype(np.float32)


class Best:
    """The k best of each query of a block so far. floor: scores that k others are known to reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | float = -np.inf) -> None:
        self.ids, self.vectors, self.single, self.norms = ids, vectors, vectors.astype(np.float32), np.sqrt(np.square(vectors).sum(1))
        self.scores, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), NONE)
        self.floor = np.full(len(ids), floor) if np.isscalar(floor) else floor
        self.visited = 0  # query-leaf pairs, for tests

    def least(self) -> np.ndarray:
        """What a score must reach to be among a query's k best."""
        return np.maximum(self.scores[:, -1], self.floor)

    def search(self, tree: Tree) -> None:
        bounds = self.vectors @ tree.centres.T + self.norms[:, None] * (tree.radii * (1 + 1e-12) + tree.sizes * 1e-12) + 1e-9

        def alive() -> np.ndarray:
            open_ = bounds >= self.least()[:, None] - 10.0**-DIGITS
            for n in range(1, len(tree.parents)):  # parents come before their children
                open_[:, n] &= open_[:, tree.parents[n]]
            return open_[:, tree.leaves]

        leaf_bounds = bounds[:, tree.leaves]
        first = leaf_bounds.argmax(1)
        enter = alive()
        if not enter.any():
            return
        first[~enter[np.arange(len(first)), first]] = -1
        enter[np.flatnonzero(first >= 0), first[first >= 0]] = False
        for leaf in range(len(tree.leaves)):
            self.visit(tree, leaf, np.flatnonzero(first == leaf))
        enter &= alive()
        for leaf in np.argsort(-leaf_bounds.max(0), kind="stable"):
            rows = np.flatnonzero(enter[:, leaf] & (leaf_bounds[:, leaf] >= self.least() - 10.0**-DIGITS))
            self.visit(tree, leaf, rows)

    def visit(self, tree: Tree, leaf: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        self.visited += len(rows)
        at = slice(tree.begins[tree.leaves[leaf]], tree.ends[tree.leaves[leaf]])
        ids, vectors = tree.ids[at], tree.vectors[at]
        with np.errstate(over="ignore", invalid="ignore"):
            rough = (self.single[rows] @ tree.single[at].T).max(1)
        slack = 1e-5 * (1 + self.norms[rows] * np.sqrt(np.square(vectors).sum(1).max())) + 10.0**-DIGITS
        rows = rows[~np.isfinite(rough) | (rough + slack >= self.least()[rows])]  # single precision may overflow
        if not len(rows):
            return
        scores = np.round(self.vectors[rows] @ vectors.T, DIGITS) + 0.0
        scores[self.ids[rows][:, None] == ids] = -np.inf
        scores = np.concatenate([self.scores[rows], scores], 1)
        found = np.concatenate([self.found[rows], np.where(np.isinf(scores[:, self.scores.shape[1] :]), NONE, ids)], 1)
        order = np.lexsort((found, -scores), 1)[:, : self.scores.shape[1]]
        self.scores[rows], self.found[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(len(column), -1)


def _grow(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = pa.Table.from_batches(list(batches))
    ids, vectors = np.asarray(whole["vec_id"]), _matrix(whole["v"])
    order = np.argsort(ids)
    yield pa.RecordBatch.from_arrays([pa.array([key[1].as_py()], pa.int64()), pa.array([pickle.dumps(Tree(ids[order], vectors[order]), 5)], pa.binary())], ["shard", "data"])


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        for batch in batches:
            if blocks is None:
                blocks = [Best(ids[a : a + BLOCK], vectors[a : a + BLOCK], k, floor[a : a + BLOCK]) for ids, vectors, floor in shared.value for a in range(0, len(ids), BLOCK)]
            for data in batch.column("data"):
                tree = pickle.loads(data.as_buffer())  # noqa: S301 made by _grow
                for best in blocks:
                    if best.vectors.shape[1] == tree.vectors.shape[1]:
                        best.search(tree)
        for best in blocks or ():
            real = (best.found != NONE) & (best.scores >= best.least()[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[np.nonzero(real)[0]], pa.int64()), pa.array(best.found[real], pa.int64()), pa.array(best.scores[real])], ["query_id", "neighbor_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the rows that have an id and a whole vector, one for each id."""
    rows = vectors.select(F.col("vec_id").try_cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "score")


def top(vectors: DataFrame, k: int = K, every: int = 1, shard: int = SHARD, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The k nearest others of every vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    n, size = rows.count(), asked.agg(F.sum("dim")).first()[0] or 0
    shards, chunks = max(1, -(-n // shard)), max(1, -(-size * 8 // chunk_bytes))
    trees = stored(rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).groupBy("dim", "shard").applyInArrow(_grow, "shard bigint, data binary"), "ball-trees")
    path = f"{shared_dir(spark)}/top-k-{uuid.uuid4().hex}"
    for chunk in range(chunks):
        queries = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(chunks)) == chunk).toArrow()  # about chunk_bytes
        dims, ids = np.asarray(queries["dim"]), np.asarray(queries["vec_id"])
        parts = [(ids[at], _matrix(queries["v"].take(pa.array(at)))) for at in (np.flatnonzero(dims == d) for d in np.unique(dims))]
        floor: dict[int, float] = {}
        for part in (0, 1):  # a sample of the shards, then the others
            some = trees.where((F.col("shard") % SEEDS == 0) if part == 0 else (F.col("shard") % SEEDS != 0)).select("data")
            shared = spark.sparkContext.broadcast([(i, v, np.array([floor.get(x, -np.inf) for x in i.tolist()])) for i, v in parts])  # about chunk_bytes
            found = some.mapInArrow(_search(shared, k), "query_id bigint, neighbor_id bigint, score double")
            if part == 0 and shards > SEEDS:
                first = stored(_best(found, k), "top-k-first")
                floor = {q: s for q, s in first.groupBy("query_id").agg(F.min("score"), F.count("*").alias("n")).where(F.col("n") == k).drop("n").collect()}  # a row for each query of the chunk
            elif part == 0:  # few shards: all at once
                found = trees.select("data").mapInArrow(_search(shared, k), "query_id bigint, neighbor_id bigint, score double")
                _best(found, k).write.mode("append").parquet(path)
                break
            else:
                _best(found.unionByName(first.drop("rank")), k).write.mode("append").parquet(path)
    return spark.read.schema("query_id bigint, rank int, neighbor_id bigint, score double").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(table(spark, sf_dir, "embeddings"), every=EVERY)


SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, round(list_inner_product(a.e, b.e), {DIGITS}) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, score FROM r WHERE rank <= {K}
"""
