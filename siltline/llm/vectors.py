"""Operator 8: near-duplicate embeddings by spherical k-means cells.

Spherical k-means over all vectors makes about sqrt(n) cells. A vector belongs to its nearest cell, and is a guest in every other cell whose centre is nearly as near (cosine within ``MARGIN``), so that a pair on
a border still meets. Within a cell, blocked cosine products find the pairs at or above ``THRESHOLD`` of which one at least belongs to the cell; those near the threshold are computed again in double precision. Linked vectors form
classes, of which the one with the least vec_id stays. Pairs that share no cell aren't seen.

Scale: an iteration is one map over the vectors with the centres broadcast (sqrt(n) rows, ``MAX_CENTRES`` at most: beyond a billion vectors cells grow, and are cut into more blocks), and sums
of a row for each task and cell. Equal vectors are one node, found by map-side combine. Cells go to tasks in pairs of blocks of ``BLOCK`` vectors, so no
task grows with a hot cell, and no partner is left out. All pairs of a cell are compared, and none is emitted: a task sends the edges that connect its blocks, and each vector's number of links. A pair that meets in two cells counts in the first.

Defined cases: a null, empty or zero vector, or one with a null, NaN or infinite element or one of 1e150 or more (or none above 1e-150), is no duplicate of anything; vectors are compared with those of their length; a null vec_id comes last in the order; rows that agree in
vec_id and vector are copies, of which ``dedup`` keeps one; ties go to the least (vec_id, row); an empty table gives no rows; further columns are carried by ``dedup``, whatever their names.

Result of ``classed``, a row for each vector: vec_id, class_id (the vec_id that stays), class_size (rows), copies (rows with this vector), links (different vectors it is linked to), keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LINKS, classes, kept_rows, links_of, row_key, stored, table

THRESHOLD = 0.95
MARGIN = 0.1
ROUNDS = 6
BLOCK = 2048
MAX_CENTRES = 1 << 15
UNSURE = 1e-5  # more than the error of single precision


def _unit(column: pa.Array, kind=np.float32) -> np.ndarray:
    m = np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    m = m / np.abs(m).max(1, keepdims=True)  # so that no square is out of range
    return (m / np.sqrt(np.square(m).sum(1, keepdims=True))).astype(kind)


def _sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, total = shared.value, None
        for batch in batches:
            x = _unit(batch.column(0))
            if total is None:
                total, count = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
            best = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
            np.add.at(total, best, x)
            count += np.bincount(best, minlength=len(centres))
        if total is not None:
            full = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(list(total[full]), pa.list_(pa.float64()))], ["cell", "s"])

    return run


def _total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = sum(np.asarray(b.column("s").flatten()).reshape(b.num_rows, -1).sum(0) for b in batches)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([sums], pa.list_(pa.float64()))], ["cell", "s"])


def centres_of(vectors: DataFrame, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres from all ``vectors(sid, v)``; the first ones are rows in the order of a hash."""
    k = int(min(MAX_CENTRES, max(1, round(n**0.5))))
    now = _unit(vectors.orderBy(F.xxhash64("v", F.lit(7)), "v").limit(k).select("v").toArrow()["v"].combine_chunks())
    spark = vectors.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(now)  # MAX_CENTRES rows at most
        sums = vectors.select("v").mapInArrow(_sums(shared), "cell int, s array<double>").groupBy("cell").applyInArrow(_total, "cell int, s array<double>").toArrow()
        made = np.asarray(sums["s"].combine_chunks().flatten()).reshape(sums.num_rows, -1)
        norm = np.sqrt(np.square(made).sum(1, keepdims=True))
        now = now.copy()
        fine = norm[:, 0] > 0
        now[np.asarray(sums["cell"])[fine]] = (made / np.maximum(norm, 1e-30))[fine]
        shared.destroy()
    return now


def _cells(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                near = _unit(part.column(1)) @ centres.T
                best = near.argmax(1)
                row, cell = np.nonzero(near >= near.max(1, keepdims=True) - MARGIN)
                taken = part.take(pa.array(row))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                guest = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(cell, pa.int32())).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(cell, pa.int32()), pa.array(best[row], pa.int32()), guest], ["sid", "v", "cell", "own", "guest"])

    return run


def links(cell: int, units: np.ndarray, own: np.ndarray, guest: list[np.ndarray], threshold: float, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of the linked pairs that this cell has to count. guest: the cells in which each vector is; left: pairs are of one of these and one of the others, else of any two."""
    single, xs, ys = units.astype(np.float32), [], []
    cells = {(i, int(c)) for i, g in enumerate(guest) for c in g} if len(set(own.tolist())) > 1 else set()
    one, others = (np.arange(len(own)),) * 2 if left is None else (np.flatnonzero(left), np.flatnonzero(~left))
    for i in range(0, len(one), 512):  # blocked products
        rows = one[i : i + 512]
        close = single[rows] @ single[others].T
        x, y = np.nonzero((close >= threshold - UNSURE) & ((own[rows] == cell)[:, None] | (own[others] == cell)))
        sure = close[x, y] >= threshold + UNSURE
        x, y = rows[x], others[y]
        fine = (y > x) if left is None else np.ones(len(x), bool)
        doubt = np.flatnonzero(fine & ~sure)
        fine[doubt] = (units[x[doubt]] * units[y[doubt]]).sum(1) >= threshold
        twice = np.flatnonzero(fine & (own[x] != own[y]) & (np.maximum(own[x], own[y]) == cell))  # it counts in the lesser of their cells, if both are there
        for t in twice:
            a, b = (x[t], y[t]) if own[x[t]] == cell else (y[t], x[t])
            fine[t] = (int(a), int(own[b])) not in cells
        xs.append(x[fine])
        ys.append(y[fine])
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compare(threshold: float):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)).combine_chunks()  # two blocks at most
        cell, i, j = (k.as_py() for k in key)
        left = None if i == j else np.asarray(whole["block"]) == i
        guest = [np.asarray(g.values) for g in whole["guest"]]
        yield links_of(np.asarray(whole["sid"]), *links(cell, _unit(whole["v"].combine_chunks(), np.float64), np.asarray(whole["own"]), guest, threshold, left))

    return run


def _linked(nodes: DataFrame, threshold: float) -> DataFrame:
    """LINKS of nodes(sid, v)."""
    rows, out = nodes.withColumn("dim", F.size("v")), None
    for dim, n in sorted(rows.groupBy("dim").count().collect()):
        some = rows.where(F.col("dim") == dim).select("sid", "v")
        shared = nodes.sparkSession.sparkContext.broadcast(centres_of(some, n))
        cells = stored(some.mapInArrow(_cells(shared), "sid bigint, v array<double>, cell int, own int, guest array<int>"), "cells")
        sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        block = cells.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        tasks = block.select("sid", "v", "own", "guest", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        tasks = tasks.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        found = tasks.groupBy("cell", "i", "j").applyInArrow(_compare(threshold), LINKS)
        out = found if out is None else out.union(found)
    return nodes.sparkSession.createDataFrame([], LINKS) if out is None else out


def grouped(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, vec_id, k, l, class_id, class_size, copies, links, keep) of all rows."""
    sound = F.expr("size(v) > 0") & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)) & F.exists("v", lambda x: F.abs(x) > 1e-150)
    keyed = vectors.select("vec_id", row_key("vec_id", "embedding").alias("k"), row_key("vec_id", "embedding", salt=7).alias("l"), F.col("embedding").cast("array<double>").alias("v"))
    rows = stored(keyed.withColumn("v", F.when(sound, F.col("v"))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    nodes = stored(rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("copies")).withColumn("sid", F.monotonically_increasing_id()), "vector-nodes")
    return classes(rows, nodes, stored(_linked(nodes.select("sid", "v"), threshold), "vector-links"), "v", "vec_id")


def classed(vectors: DataFrame) -> DataFrame:
    """A row for each vector: its class, and whether it stays."""
    return grouped(vectors).drop("row", "k", "l")


def dedup(vectors: DataFrame) -> DataFrame:
    """``vectors`` with one row of each class, all columns kept."""
    return kept_rows(vectors, grouped(vectors), "vec_id", "embedding")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classed(table(spark, sf_dir, "embeddings"))
