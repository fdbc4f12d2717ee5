"""Operator 10: near-duplicate documents by min-max hashing.

Each of 64 permutations of a document's word 3-grams gives two values, the least and the greatest hash, so 128 values cost
64 hash evaluations. The share of agreeing values estimates the Jaccard similarity without bias and with less variance than
128 independent minima would have. 32 bands of 4 values (two permutations each) propose candidates; two documents are linked if
at least half of the 128 values agree; linked documents form classes, of which the one with the least ``doc_id`` stays.

Scale: one map pass over the texts makes 256-byte signatures; from there on only these move. Documents with equal signatures
are one node, found by map-side combine, so a third of all rows may be copies. Buckets are never lists: a bucket of ``BLOCK``
signatures or more is compared by pairs of blocks, one bucket stands for all that have the same members, and a pair that shares several is counted in the first.
All pairs of a bucket are compared, and none is emitted: a task sends the edges that connect its block, and each node's number of links.
There is no cap on buckets or partners. ``dedup`` moves only texts that a Bloom filter of the rows that go lets through.

Defined cases: a document without words (null, empty, only signs) is no duplicate of anything; fewer than three words make
one shingle of what there is; rows that agree in doc_id and text are copies (``dedup`` keeps one of them); a null doc_id
comes last in the order; further columns are carried by ``dedup``, whatever their names. Words are runs of ASCII letters, digits, "_" and all
other non-ASCII characters, lower-cased in ASCII and Latin-1 only, so an unspaced text (Chinese) is few words. An empty table gives an empty result.

Result of ``classed``, a row for each document: doc_id, class_id (the doc_id that stays), class_size (documents), copies (documents with this signature), links (different signatures it is linked to), keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LINKS, classes, kept_rows, links_of, row_key, stored, table
from .words import buffers, mix, pieces, word_hashes

PERMUTATIONS = 64
SHINGLE = 3
THRESHOLD = 0.5
BAND = 4  # 16-bit values, so that a band is a 64-bit number
BLOCK = 2048

_RNG = np.random.Generator(np.random.PCG64(20240607))
_A = _RNG.integers(0, 1 << 31, PERMUTATIONS, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, np.uint32)


def shingles(words: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the word k-grams of each text, and for each text the index of its first; fewer than k words make one."""
    counts = np.diff(first)
    end = np.repeat(first[1:], counts)
    at = np.arange(len(words))
    h = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        h = h * np.uint64(0x100000001B3) + np.where(at + j < end, padded[j : j + len(words)], np.uint64(0))
    made = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    keep = at - np.repeat(first[:-1], counts) < np.repeat(made, counts)
    return (mix(h)[keep] >> np.uint64(32)).astype(np.uint32), np.concatenate([[0], np.cumsum(made)])


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint16 signatures of 2 * PERMUTATIONS values, for texts that have a shingle (first: their starts)."""
    out = np.empty((len(first), PERMUTATIONS, 2), np.uint16)
    value = np.empty_like(hashes)
    for p in range(PERMUTATIONS):
        np.multiply(hashes, _A[p], out=value)
        value += _B[p]
        out[:, p, 0] = np.minimum.reduceat(value, first)
        out[:, p, 1] = np.maximum.reduceat(value, first)
    return out.reshape(len(first), -1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = 2 * PERMUTATIONS // BAND
    for batch in batches:
        rows, sigs = [np.zeros(0, np.int64)], [np.zeros((0, 2 * PERMUTATIONS), np.uint16)]
        for i, j, body, offsets in pieces(*buffers(batch.column(3))):
            hashes, first = shingles(*word_hashes(body, offsets))
            full = np.flatnonzero(np.diff(first))
            if len(full):
                rows.append(full + i)
                sigs.append(signatures(hashes, first[full]))
        rows, flat = np.concatenate(rows), np.concatenate(sigs).view(np.int64)
        has = np.zeros(batch.num_rows, np.int64)
        has[rows] = width
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has)]).astype(np.int32)), pa.array(flat.ravel()), mask=pa.array(has == 0))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], ["doc_id", "k", "l", "sig"])


def links(sigs: np.ndarray, band: int, left: np.ndarray | None = None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of the linked pairs of a bucket of this band that share no band before it. sigs: a row of 64-bit bands for each; left: pairs are of one of these and one of the others, else of any two."""
    values = sigs.view(np.uint16)
    need, xs, ys = threshold * values.shape[1], [], []
    one, others = (np.arange(len(sigs)), None) if left is None else (np.flatnonzero(left), np.flatnonzero(~left))
    for x in one:
        rest = np.arange(x + 1, len(sigs)) if others is None else others
        if band:
            rest = rest[~(sigs[rest, :band] == sigs[x, :band]).any(1)]
        near = rest[(values[rest] == values[x]).sum(1) >= need]
        if len(near):
            xs.append(np.full(len(near), x))
            ys.append(near)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, key, i, j, block, sid, sig) sorted by the first four: a run of them is a bucket, or a pair of blocks of it."""
    rest = None

    def runs(whole: pa.Table, last: bool) -> tuple[list[tuple], pa.Table]:
        keys = np.stack([whole[c].to_numpy().astype(np.int64) for c in ("band", "key", "i", "j")])
        at = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [whole.num_rows]])
        sids, block = whole["sid"].to_numpy(), whole["block"].to_numpy()
        sigs = whole["sig"].combine_chunks().flatten().to_numpy().reshape(whole.num_rows, -1)
        ends = at if last else at[:-1]
        return [(sids[a:b], sigs[a:b], int(keys[0, a]), block[a:b] == keys[2, a] if keys[2, a] != keys[3, a] else None) for a, b in zip(ends[:-1], ends[1:])], whole.slice(int(ends[-1]))

    def said(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, xs, ys, base = [], [], [], 0
        for sids, sigs, band, left in found:
            x, y = links(sigs, band, left)
            if len(x):
                ids.append(sids)
                xs.append(x + base)
                ys.append(y + base)
                base += len(sids)
        if ids:
            yield links_of(np.concatenate(ids), np.concatenate(xs), np.concatenate(ys))

    for batch in batches:
        now = pa.Table.from_batches([batch])
        found, rest = runs(now if rest is None or not rest.num_rows else pa.concat_tables([rest, now]), False)
        yield from said(found)
    if rest is not None and rest.num_rows:
        yield from said(runs(rest, True)[0])


def _linked(nodes: DataFrame) -> DataFrame:
    """LINKS of nodes(sid, sig)."""
    bands = nodes.select("sid", F.posexplode("sig").alias("band", "key"))
    buckets = bands.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("sid").alias("low"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y")).where("m > 1")
    first = buckets.groupBy("m", "low", "x", "y").agg(F.min(F.struct("band", "key")).alias("b")).select("b.*", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))  # of buckets with the same members, that of the first band sees every pair that is new
    members = bands.join(first, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    tasks = members.join(nodes, "sid").select("band", "key", "sid", "sig", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "sig")
    return tasks.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j").mapInArrow(_compare, LINKS)


def grouped(docs: DataFrame) -> DataFrame:
    """(row, doc_id, k, l, class_id, class_size, copies, links, keep) of all rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("k"), row_key("doc_id", "text", salt=7).alias("l"), F.col("text").cast("string").alias("text"))
    rows = stored(keyed.mapInArrow(_sign, f"doc_id {kind}, k bigint, l bigint, sig array<bigint>").withColumn("row", F.monotonically_increasing_id()), "minmax")
    nodes = stored(rows.where("sig IS NOT NULL").groupBy("sig").agg(F.count("*").alias("copies")).withColumn("sid", F.monotonically_increasing_id()), "minmax-nodes")
    return classes(rows, nodes, stored(_linked(nodes.select("sid", "sig")), "minmax-links"), "sig", "doc_id")


def classed(docs: DataFrame) -> DataFrame:
    """A row for each document: its class, and whether it stays."""
    return grouped(docs).drop("row", "k", "l")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, all columns kept."""
    return kept_rows(docs, grouped(docs), "doc_id", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classed(table(spark, sf_dir, "documents"))
