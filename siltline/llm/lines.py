"""Operator 4: line dedup over the whole corpus with two Bloom filters.

Every line that isn't blank stays in one place only: its first occurrence by (doc_id, row key, line number). One filter holds the hashes
seen once, the other those seen twice; a line whose hash isn't in the second can't be a repeat and never moves. Only suspected repeats are shuffled,
compared as text, and the first of each chosen.

How: the JVM hashes the lines of each document (8 bytes a line go to a scratch table). Each task turns its hashes into positions of both filters, cut into
segments; segments are merged by position, twice |= once & other once | other twice, which can only suspect too much. The positions that are set
in the second filter are folded into a small filter which all tasks get. It grows with the number of repeated lines, so its size is
checked: beyond ``MAX_FILTER`` positions it stays in segments, and lines are looked up there by a semi-join of (row key, line number, position), with the same result.
Suspects are grouped by hash with the least and greatest text, so that unequal lines with one hash are noticed (and then told apart by their text). Hot lines are combined before the shuffle.
The documents that lose a line are shuffled once, to take the numbers of the lines that go; a Bloom filter of their keys lets the others stay where they are (nearly all of them, up to some
hundred million documents that lose a line; beyond, the filter, whose size is bounded, lets more and more of them through).

Defined cases: a null text stays null, an empty one empty; blank lines (of spaces, tabs and "\r" only) stay and repeat freely; the parts of a text are what "\n" separates; rows that
agree in doc_id and text count as one document and get the same result; a null doc_id comes last; further columns are
carried, whatever their names (one named like ``removed`` is replaced); an empty table gives an empty result. A document may lose all its lines: ``dedup`` gives it an empty text, ``dedup(drop_emptied=True)`` leaves it out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MAX_BITS, SEGMENT, bitmap, fresh, row_key, split_by_keys, stored, table
from .words import mix

BITS_PER_LINE = 16
MAX_FILTER = 1 << (MAX_BITS - 3)  # positions set in the second filter, for one that is sent to all tasks: 64 MB at most
BLANK = " \t\r"


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two positions of each hash in a filter of 2^bits."""
    mask = np.uint64((1 << bits) - 1)
    h = hashes.view(np.uint64)
    return np.stack([h & mask, mix(h) & mask])


def _segments(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [np.asarray(b.column(0).flatten().drop_null()) for b in batches]
        if not hashes:
            return
        distinct, counts = np.unique(np.concatenate(hashes), return_counts=True)
        sets = [np.unique(_positions(h, bits)) for h in (distinct, distinct[counts > 1])]
        cuts = [np.searchsorted(s, np.arange(0, (1 << bits) + 1, 1 << SEGMENT, dtype=np.uint64)) for s in sets]
        low = np.uint64((1 << SEGMENT) - 1)
        for k in np.flatnonzero(np.diff(cuts[0])):
            once, twice = (s[c[k] : c[k + 1]] for s, c in zip(sets, cuts))
            yield pa.RecordBatch.from_arrays([pa.array([int(k)]), *(pa.array([(x & low).astype(np.uint32).tobytes()], pa.binary()) for x in (once, twice))], ["segment", "once", "twice"])

    return run


def _merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once, twice = np.zeros(1 << SEGMENT, bool), np.zeros(1 << SEGMENT, bool)
    for batch in batches:
        for a, b in zip(batch.column("once"), batch.column("twice")):
            at = np.frombuffer(a.as_py(), np.uint32)
            twice[at[once[at]]] = True
            once[at] = True
            twice[np.frombuffer(b.as_py(), np.uint32)] = True
    at = np.flatnonzero(twice)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at + (key[0].as_py() << SEGMENT), pa.int64())], ["at"])


def _suspect(folded: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    small = np.uint64(len(folded) * 8 - 1)
    found = np.ones(len(hashes), bool)
    for p in _positions(hashes, bits):
        p = p & small
        found &= (folded[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _hashes(text: F.Column) -> F.Column:
    """The hash of each line, null for a blank one."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(F.trim(x, F.lit(BLANK)) != "", F.xxhash64(x)))


def _suspects(docs: DataFrame, hashed: DataFrame) -> DataFrame:
    """``docs(k, l, o, text)`` with ``sus``, the numbers of the lines that may be repeats."""
    spark = docs.sparkSession
    total = hashed.agg(F.sum(F.size("hashes"))).first()[0] or 0
    bits = max(SEGMENT, int(total * BITS_PER_LINE - 1).bit_length())
    twice = stored(hashed.select("hashes").mapInArrow(_segments(bits), "segment bigint, once binary, twice binary").groupBy("segment").applyInArrow(_merge, "at bigint"), "bloom")
    size = twice.count()
    if size > MAX_FILTER:
        places = hashed.select("k", "l", F.posexplode("hashes").alias("line_no", "h")).where("h IS NOT NULL").withColumn("at", F.col("h").bitwiseAND((1 << bits) - 1))
        found = stored(places.join(twice, "at", "left_semi").groupBy("k", "l").agg(F.collect_set("line_no").alias("sus")), "line-places")  # a row is as long as its document
        return split_by_keys(docs, "k", found.select("k"))[0].join(found.hint("shuffle_hash"), ["k", "l"])
    small = max(SEGMENT, min(bits, int(size * 8 - 1).bit_length()))
    folded = bitmap(twice.select(F.col("at").bitwiseAND((1 << small) - 1).alias("p")), small)
    shared = spark.sparkContext.broadcast(folded)  # its size was checked above

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def suspected(lists: pa.Array) -> pa.Array:
        flat, sizes = lists.flatten(), np.asarray(lists.value_lengths().fill_null(0))
        begin = np.concatenate([[0], np.cumsum(sizes)])
        real = np.flatnonzero(~np.asarray(flat.is_null()))
        found = real[_suspect(shared.value, bits, np.asarray(flat.fill_null(0), np.int64)[real])]
        offsets = np.searchsorted(found, begin)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array((found - np.repeat(begin[:-1], np.diff(offsets))).astype(np.int32)))

    return docs.withColumn("sus", suspected(_hashes(F.col("text"))))


def removals(docs: DataFrame) -> DataFrame:
    """(k, l, gone): the numbers, from 0, of the lines that go, for each document that loses one."""
    keyed = docs.select(row_key("doc_id", "text").alias("k"), row_key("doc_id", "text", salt=7).alias("l"), F.struct(F.col("doc_id").isNull().alias("n"), "doc_id").alias("o"), F.col("text").cast("string").alias("text"))
    hashed = stored(keyed.select("k", "l", _hashes(F.col("text")).alias("hashes")).where("hashes IS NOT NULL"), "line-hashes")
    lines = _suspects(keyed, hashed).where(F.size("sus") > 0).select("k", "l", "o", F.split("text", "\n", -1).alias("parts"), F.explode("sus").alias("line_no"))
    lines = lines.select(F.struct("o", "k", "l", "line_no").alias("at"), F.col("parts")[F.col("line_no")].alias("line"))
    suspects = stored(lines.select(F.xxhash64("line").alias("h"), "at", "line"), "line-suspects")
    firsts = stored(suspects.groupBy("h").agg(F.min("at").alias("first"), F.max("at").alias("last"), (F.min("line") != F.max("line")).alias("mixed")).where("first != last OR mixed"), "line-firsts")
    gone = suspects.select("h", "at").join(firsts.where("NOT mixed").select("h", "first"), "h").where("at != first").select("at.k", "at.l", "at.line_no")
    mixed = firsts.where("mixed").select("h")
    if mixed.head(1):  # different lines with one hash: told apart by their text
        place = F.row_number().over(Window.partitionBy("h", "line").orderBy("at"))
        gone = gone.unionByName(suspects.join(mixed, "h", "left_semi").distinct().withColumn("place", place).where("place > 1").select("at.k", "at.l", "at.line_no"))
    return stored(gone.groupBy("k", "l").agg(F.collect_set("line_no").alias("gone")), "lines-that-go")


def dedup(docs: DataFrame, drop_emptied: bool = False, removed: str | None = None) -> DataFrame:
    """``docs`` without repeated lines. removed: name of a column for the number of lines that went."""
    k, l, out_k, out_l, out = fresh(docs, "__k", "__l", "__out_k", "__out_l", "__gone")
    parts = F.split(F.col("text").cast("string"), "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(out)), lambda i: parts[i])
    going = removals(docs).toDF(out_k, out_l, out)
    maybe, whole = split_by_keys(docs.withColumn(k, row_key("doc_id", "text")).withColumn(l, row_key("doc_id", "text", salt=7)), k, going)
    joined = maybe.join(going.hint("shuffle_hash"), (F.col(k) == F.col(out_k)) & (F.col(l) == F.col(out_l)), "left")
    joined = joined.withColumn("text", F.when(F.col(out).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if drop_emptied:
        joined = joined.where(F.col(out).isNull() | F.col("text").rlike(f"[^{BLANK}\n]"))
    if removed:
        joined, whole = joined.withColumn(removed, F.coalesce(F.size(out), F.lit(0))), whole.withColumn(removed, F.lit(0))
    names = [*(c for c in docs.columns if c != removed), *([removed] if removed else [])]
    return joined.select(names).unionByName(whole.select(names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="lines_removed")


SQL = """
WITH parts AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
placed AS (SELECT *, CASE WHEN trim(line, ' ' || chr(9) || chr(13)) = '' THEN 1 ELSE row_number() OVER (PARTITION BY line ORDER BY doc_id, i) END AS n FROM parts),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE n = 1) AS text, count(*) FILTER (WHERE n > 1) AS gone FROM placed GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(k.gone, 0) AS INTEGER) AS lines_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
