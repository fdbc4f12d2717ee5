"""Operator 1: best-fit packing of documents into training sequences, by best-two-fit.

A bin is filled greedily: the longest unpacked piece that fits goes in, until none fits. Then its smallest piece may be replaced: of all pairs of unpacked pieces that fit the
gap it would leave, the pair with the greatest sum goes in if it fills the bin more tightly than the piece did. A bin of one piece isn't changed. A document longer than a bin is cut
into pieces of a bin's length, which are bins by themselves, and a rest. Each piece is followed by ``END``, for which it needs room. Lengths are counted in characters (``CAPACITY`` = 8192, about 2048 tokens of 4).

Scale: documents go to shards by the hash of their id, text and input partition, one shuffle; a shard (about ``SHARD`` bytes of text, so that their number grows with the corpus) is packed by one task and
its bins come out with their text. Only the last bins of a shard are loose, some ten of thousands. Rows without an id, with one id or equal in all spread like others, at most those of one input partition to a shard.

Defined cases: a null or empty text isn't packed; a null doc_id is packed as one, under a null; repeated rows are packed each; ties between pieces of equal length go by doc_id (nulls last), text and
place in the text; an empty table gives no bins; further columns are ignored, whatever their names. Which bin a document is in depends on how the table is split.

Result: bin_id, doc_ids (of the type of doc_id), starts and lengths (of the pieces, as characters of their documents), used (lengths and ends), text (the pieces one after the other, each with its end).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CAPACITY = 8192
SHARD = 12 << 20
END = "\n"


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into lengths (each 1..capacity). Among equal lengths the lower index goes first."""
    queues: dict[int, deque[int]] = {}
    for i, n in enumerate(lengths):
        queues.setdefault(n, deque()).append(i)
    free = sorted(queues)  # the lengths of which there are unpacked pieces
    count = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, np.int64)
    bins = []

    def take(n: int) -> int:
        i = queues[n].popleft()
        count[n] -= 1
        if not queues[n]:
            free.pop(bisect_left(free, n))
        return i

    while free:
        chosen, gap = [], capacity
        while (k := bisect_right(free, gap)) > 0:
            gap -= free[k - 1]
            chosen.append((free[k - 1], take(free[k - 1])))
        if gap and len(chosen) > 1:
            least, index = chosen[-1]
            found = best_pair(count, gap + least)
            if found and sum(found) > least:
                chosen.pop()
                count[least] += 1
                if queues[least]:
                    queues[least].appendleft(index)
                else:
                    queues[least].append(index)
                    free.insert(bisect_left(free, least), least)
                chosen += [(n, take(n)) for n in found]
        bins.append([i for _, i in chosen])
    return bins


def best_pair(count: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths a >= b with the greatest a + b <= room; of equal sums that with the greatest a. count: unpacked pieces by length."""
    room = min(room, 2 * (len(count) - 1))
    lower = np.maximum.accumulate(np.where(count[: room // 2 + 1] > 0, np.arange(room // 2 + 1), 0))  # the greatest unpacked length up to each
    a = np.arange(room // 2 + 1, min(room, len(count)))
    sums = np.where((count[a] > 0) & (lower[room - a] > 0), a + lower[room - a], 0) if len(a) else np.zeros(1, np.int64)
    at = len(sums) - 1 - int(np.argmax(sums[::-1]))
    half = int(lower[-1])  # both in the lower half: the greatest with itself or the next below
    other = half if half and count[half] > 1 else int(lower[half - 1]) if half else 0
    if other and half + other > sums[at]:
        return half, other
    return (int(a[at]), int(sums[at] - a[at])) if sums[at] > 0 else None


def _shard(capacity: int):
    longest = capacity - len(END)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        ids, texts = whole["doc_id"].to_pylist(), whole["text"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, "" if ids[i] is None else ids[i], texts[i]))
        parts = [(i, at, min(longest, len(texts[i]) - at)) for i in order for at in range(0, len(texts[i]), longest)]
        made = 0
        bins = pack([p[2] + len(END) for p in parts], capacity)
        for first in range(0, len(bins), 256):
            rows = [[parts[i] for i in b] for b in bins[first : first + 256]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(key[0].as_py() << 32) + made + k for k in range(len(rows))], pa.int64()),
                    pa.array([[ids[i] for i, _, _ in r] for r in rows], pa.list_(whole.schema.field("doc_id").type)),
                    pa.array([[at for _, at, _ in r] for r in rows], pa.list_(pa.int32())),
                    pa.array([[n for _, _, n in r] for r in rows], pa.list_(pa.int32())),
                    pa.array([sum(n + len(END) for _, _, n in r) for r in rows], pa.int32()),
                    pa.array(["".join(texts[i][at : at + n] + END for i, at, n in r) for r in rows], pa.string()),
                ],
                ["bin_id", "doc_ids", "starts", "lengths", "used", "text"],
            )
            made += len(rows)

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_bytes: int = SHARD) -> DataFrame:
    """The bins of all documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    some = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text != ''")
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    placed = some.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(shards)))
    return placed.groupBy("shard").applyInArrow(_shard(capacity), f"bin_id bigint, doc_ids array<{kind}>, starts array<int>, lengths array<int>, used int, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
