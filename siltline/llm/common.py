"""What the operators of this subpackage share: scratch tables, row keys, Bloom filters, connected components and classes of duplicates."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder within the one that all executors share, from ``spark.checkpoint.dir``; it goes when the application ends. Where that is unset: a local folder, if Spark runs in one process (tests), else an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="siltline-")
            atexit.register(shutil.rmtree, _OWN["dir"], True)
        return _OWN["dir"]
    own = f"{folder.rstrip('/')}/siltline-{context.applicationId}"
    if own not in _OWN:
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWN[own] = own
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it again. It survives a lost executor."""
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python in batches of a few MB: rows here hold whole texts, and Spark's 10,000 of them would fill both the JVM's and the workers' memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return [next(x for i in range(len(taken) + 1) if (x := f"{n}_{i}" if i else n).lower() not in taken) for n in names]


def row_key(*columns, salt: int | None = None) -> F.Column:
    """A 64-bit key of a row; rows that agree in all these columns (null equals null) share it. Keys with and without a salt together are one of 128 bits."""
    parts = [x for c in columns for x in (F.col(c) if isinstance(c, str) else c,)]
    return F.xxhash64(*([] if salt is None else [F.lit(salt)]), *[x for p in parts for x in (p.isNull(), p)])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a bigint, b bigint)``, as ``(node, root)`` with the least node as root.

    Alternates large-star and small-star steps, each two shuffles; a round is written to the shared folder, so that
    neither the plan nor what a lost executor costs grows. Ends when a round changes nothing, after a logarithmic number of rounds.
    Self loops are ignored; nodes without an edge don't appear; no edges give no rows.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: b's lesser neighbours, and b itself, go to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        now = stored(small.union(least.select(F.col("m").alias("a"), "b")).distinct(), "cc")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        mark = tuple(seen)
    raise RuntimeError("components: no end after %d rounds" % max_rounds)


SEGMENT = 20  # bits of a position within a segment of a filter
MAX_BITS = 29  # of a filter that is sent to all tasks: 64 MB at most


def _bits(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The positions of one segment of a filter as a bitmap."""
    bits = np.zeros(1 << SEGMENT, bool)
    for batch in batches:
        bits[np.asarray(batch.column("p")) & ((1 << SEGMENT) - 1)] = True
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])


def bitmap(positions: DataFrame, bits: int) -> np.ndarray:
    """A filter of 2^bits positions (SEGMENT <= bits <= MAX_BITS), in bytes, from a column p of those that are set."""
    made = positions.groupBy(F.shiftright("p", SEGMENT).alias("segment")).applyInArrow(_bits, "segment bigint, bits binary").toArrow()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for segment, part in zip(made["segment"].to_pylist(), made["bits"].to_pylist()):
        out[segment << (SEGMENT - 3) : (segment + 1) << (SEGMENT - 3)] = np.frombuffer(part, np.uint8)
    return out


def split_by_keys(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` may be in the first column of ``keys``, those whose key surely isn't). Whole rows that no join needs to see stay where they are.

    A Bloom filter of the keys goes to all tasks. Its size is bounded; with more keys than it was made for it lets more rows through, and nothing else changes."""
    bits = max(SEGMENT, min(MAX_BITS, int(keys.count() * 8 - 1).bit_length()))
    k, mask = F.col(keys.columns[0]), (1 << bits) - 1
    full = bitmap(keys.select(F.explode(F.array(k.bitwiseAND(mask), F.shiftrightunsigned(k, 64 - bits))).alias("p")), bits)
    shared = rows.sparkSession.sparkContext.broadcast(full)  # 2^MAX_BITS bits at most

    @F.arrow_udf(T.BooleanType())
    def maybe(column: pa.Array) -> pa.Array:
        h = np.asarray(column.fill_null(0), np.int64).view(np.uint64)
        found = np.ones(len(h), bool)
        for p in (h & np.uint64(mask), h >> np.uint64(64 - bits)):
            found &= (shared.value[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return pa.array(found)

    return rows.where(maybe(F.col(key))), rows.where(~maybe(F.col(key)))


def spanning(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one it is connected with by the edges (x, y)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def links_of(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """What a task says of the pairs (x, y) of its nodes: (a, b, null) for edges that connect the same nodes, (a, null, n) for the number of pairs a node is in."""
    label, n = spanning(len(ids), x, y), np.bincount(x, minlength=len(ids)) + np.bincount(y, minlength=len(ids))
    edge, node = np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(n)
    none = pa.nulls(len(edge), pa.int64())
    a, b, count = pa.array(np.concatenate([ids[edge], ids[node]])), [pa.array(ids[label[edge]]), pa.nulls(len(node), pa.int64())], [none, pa.array(n[node].astype(np.int64))]
    return pa.RecordBatch.from_arrays([a, pa.concat_arrays(b), pa.concat_arrays(count)], ["a", "b", "n"])


LINKS = "a bigint, b bigint, n bigint"


def classes(rows: DataFrame, nodes: DataFrame, links: DataFrame, key: str, name: str) -> DataFrame:
    """``rows(row, <name>, k, l, <key>)`` with class_id, class_size, copies, links and keep. nodes: (<key>, sid, copies), the different contents of the rows; links: LINKS of the nodes.

    A class is a component of linked contents with all their rows; class_id is the id of the one that is kept, the first by (<name>, row), nulls last. A row with a null key is a class of its own."""
    roots = components(links.where("b IS NOT NULL").select("a", "b"))
    degrees = links.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("links"))
    info = nodes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").join(degrees.withColumnRenamed("a", "sid"), "sid", "left").select(key, F.coalesce("root", "sid").alias("root"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    order = F.struct(F.col(name).isNull().alias("n"), F.col(name).alias("id"), "row")
    placed = rows.join(info, key, "left").select("row", name, "k", "l", order.alias("o"), F.coalesce("root", -1 - F.col("row")).alias("root"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
    placed = stored(placed, "placed")
    best = placed.groupBy("root").agg(F.min("o").alias("best"), F.count("*").alias("class_size"))
    return placed.join(best, "root").select("row", name, "k", "l", F.col("best.id").alias("class_id"), "class_size", "copies", "links", (F.col("row") == F.col("best.row")).alias("keep"))


def kept_rows(rows: DataFrame, classed: DataFrame, *key: str) -> DataFrame:
    """``rows`` without those of ``classed`` (by its k and l, the keys of these columns) that aren't kept; of equal rows of which one is kept, one stays. Only rows that may go, or be there again, are shuffled."""
    k, l, out_k, out_l, again = fresh(rows, "__k", "__l", "__out_k", "__out_l", "__again")
    states = classed.where("class_size > 1").groupBy("k", "l").agg(F.bool_or("keep").alias("some"), F.bool_and("keep").alias("all")).where("NOT all")
    states = stored(states.select(F.col("k").alias(out_k), F.col("l").alias(out_l), F.col("some").alias(again)), "rows-that-go")
    marked = rows.withColumn(k, row_key(*key)).withColumn(l, row_key(*key, salt=7))
    maybe, clean = split_by_keys(marked, k, states)
    joined = maybe.join(states, (F.col(k) == F.col(out_k)) & (F.col(l) == F.col(out_l)), "left")
    kept = joined.where(F.col(again).isNull())
    if states.where(F.col(again)).head(1):
        kept = kept.unionByName(joined.where(F.col(again)).dropDuplicates([k, l]))
    return kept.select(*clean.columns).unionByName(clean).drop(k, l)
