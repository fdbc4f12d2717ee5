"""Operator 5: quality classifier, a factorisation machine over hashed words, structure statistics and metadata.

score = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ], so all pairwise interactions cost time
linear in the number of features. Two heads share the features: low quality (labels.quality) and toxicity (labels.toxic). A document is
kept if it is scored good and not toxic.

Features are presences: each distinct lower-cased word and word beginning hashed into 2^20 buckets, 14 structure statistics of the whole text (lengths, shares of
capitals, digits, signs, blanks, distinct words, ...) in 16 steps each, and hashed ``lang`` and ``source``.

Scale: training reads at most ``MAX_TRAIN`` labelled rows (by hash order, the documented bound; the model's size is fixed too);
scoring is one map over all documents with the model broadcast, and shuffles nothing.

Defined cases: a null or empty text has no words and is scored by its statistics and metadata alone; null metadata is a value
of its own; labels with a null in doc_id, quality or toxic are left out; repeated labels count once, and contradicting ones
by their means; of documents with one doc_id one is learned from; with no usable label, or none of one class, that head gives its constant (nothing is rejected with no label at all).
Repeated rows get equal scores. Further columns are carried by ``keep``, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, row_key, small_batches, table
from .words import PIECE, buffers, pieces, word_hashes

BUCKETS = 1 << 20
STEPS = 16
STATS = 14
META = 1024
WIDTH = BUCKETS + STATS * STEPS + 2 * META
RANK = 4
MAX_TRAIN = 16000
PREFIXES = (3, 5)  # word beginnings of so many bytes are features as well, for inflected and coined words
MIN_DOCS = 12  # a feature in fewer of MAX_TRAIN training documents has no weight; of fewer documents, the limit falls as a power of 0.375 of them, so that of up to 20 every feature has one
EPOCHS = 6
UPDATES = 100  # at least; few documents are gone through more often
BATCH = 128
RATE = 0.2
RATE_PAIRS = 0.05
DECAY = 5e-3


def _share(mask: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(of, 1)


def _steps(body: np.ndarray, offsets: np.ndarray, words: np.ndarray, distinct: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The structure statistics of each text, each as one of STEPS steps."""
    n = np.diff(offsets).astype(float)
    capital, small = (body >= 65) & (body <= 90), (body >= 97) & (body <= 122)
    digit, blank, wide = (body >= 48) & (body <= 57), (body <= 32), body >= 128
    sign = ~(capital | small | digit | blank | wide)
    lines = _share(body == 10, offsets, np.ones_like(n)) + 1
    letters = n * (_share(capital | small | wide, offsets, n))
    shares = [
        _share(capital, offsets, letters), _share(digit, offsets, n), _share(sign, offsets, n), _share(blank, offsets, n), _share(wide, offsets, n),
        _share(body == 124, offsets, words) / 2, _share(np.isin(body, np.frombuffer(b"!#$%&*", np.uint8)), offsets, words) / 4, distinct / np.maximum(words, 1), top / np.maximum(words, 1),
        _share(np.isin(body, np.frombuffer(b".,;:?", np.uint8)), offsets, words),
    ]
    logs = [np.log2(n + 1) * 0.8, np.log2(words + 1), np.log2(lines) * 1.5, n / np.maximum(words, 1)]
    return np.stack([*(np.clip(np.sqrt(s) * STEPS, 0, STEPS - 1).astype(np.int64) for s in shares), *(np.clip(x, 0, STEPS - 1).astype(np.int64) for x in logs)], 1)


def _changes(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)


def _metadata(values: list) -> np.ndarray:
    known: dict = {}
    return np.array([known[v] if v in known else known.setdefault(v, zlib.crc32(b"\0" if v is None else str(v).encode()) % META) for v in values], np.int64)


def features(texts: pa.Array, langs: list, sources: list, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature ids, offsets) for runs of texts; the ids of one text are distinct."""
    lang, source = _metadata(langs), _metadata(sources)
    for i, j, body, offsets in pieces(*buffers(texts), size):
        hashes, first, *more = word_hashes(body, offsets, True, PREFIXES)
        words = np.diff(first)
        texts_of = np.repeat(np.arange(j - i), words) << 20
        keys = np.sort(texts_of | (hashes & np.uint64(BUCKETS - 1)).astype(np.int64))
        counts = np.diff(np.append(at := np.flatnonzero(_changes(keys)), len(keys)))
        top, own = np.zeros(j - i, np.int64), np.bincount(keys[at] >> 20, minlength=j - i)
        np.maximum.at(top, keys[at] >> 20, counts)
        keys = np.sort(np.concatenate([keys[at], *(texts_of | (h & np.uint64(BUCKETS - 1)).astype(np.int64) for h in more)]))
        keys = keys[_changes(keys)]
        doc, ids = keys >> 20, keys & (BUCKETS - 1)
        distinct = np.bincount(doc, minlength=j - i)
        steps = _steps(body, offsets, words.astype(float), own, top) + BUCKETS + np.arange(STATS) * STEPS
        meta = np.stack([lang[i:j], source[i:j] + META], 1) + BUCKETS + STATS * STEPS
        fixed = np.concatenate([steps, meta], 1)
        ends = np.cumsum(distinct + fixed.shape[1])
        out = np.empty(int(ends[-1]), np.int64)
        begin = np.concatenate([[0], ends[:-1]])
        out[(begin[:, None] + np.arange(fixed.shape[1])).ravel()] = fixed.ravel()
        out[np.repeat(begin + fixed.shape[1] - np.concatenate([[0], np.cumsum(distinct)[:-1]]), distinct) + np.arange(len(ids))] = ids
        yield out, np.append(begin, ends[-1])


def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of x over runs that begin there and end with the next; an empty run gives 0."""
    out = np.zeros((len(begin) - 1, *x.shape[1:]), x.dtype)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        out[full] = np.add.reduceat(x, begin[:-1][full], 0)
    return out


class Machine:
    """Weights of both heads: a row of (w, v_1..v_RANK) * 2 for each feature that has any (rows[0]: none), and w0 of each head."""

    def __init__(self, bias: np.ndarray, used: np.ndarray, rows: np.ndarray) -> None:
        self.bias, self.rows = bias, np.concatenate([np.zeros((1, 2 * (1 + RANK)), np.float32), rows.astype(np.float32)])
        self.place = np.zeros(WIDTH, np.int32)
        self.place[used] = np.arange(1, len(used) + 1)

    def logits(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros((0, 2))
        x = self.rows[self.place[ids]].reshape(len(ids), 2, 1 + RANK)
        total = _sums(x, offsets)
        square = _sums(np.square(x[:, :, 1:]).sum(2), offsets)
        return self.bias + total[:, :, 0] + (np.square(total[:, :, 1:]).sum(2) - square) / 2


def fit(ids: np.ndarray, offsets: np.ndarray, targets: np.ndarray, seed: int = 11) -> Machine:
    """Adagrad on the logistic loss of both heads. targets: (n, 2) of good and toxic, in 0..1."""
    rng = np.random.default_rng(seed)
    n = len(targets)
    if not n:
        return Machine(np.array([20.0, -20.0]), np.zeros(0, np.int64), np.zeros((0, 2 * (1 + RANK))))
    mean = targets.mean(0).clip(1e-6, 1 - 1e-6)
    bias = np.log(mean / (1 - mean))
    heads = (targets.min(0) < 0.5) & (targets.max(0) > 0.5)  # a head with one class stays constant
    often = np.zeros(WIDTH, np.int64)
    for a in range(0, len(ids), 1 << 20):  # in parts, as the counting copies them
        often += np.bincount(ids[a : a + (1 << 20)], minlength=WIDTH)
    often = often >= max(1.0, MIN_DOCS * (n / MAX_TRAIN) ** 0.375)
    used = np.flatnonzero(often)
    local = np.full(WIDTH, -1, np.int32)
    local[used] = np.arange(len(used))
    keep = often[ids]
    starts = np.concatenate([[0], np.cumsum(keep)])[offsets]
    ids = local[ids[keep]].astype(np.int32)
    weights = np.zeros((len(used), 2, 1 + RANK))
    weights[:, :, 1:] = rng.normal(0, 0.01, weights[:, :, 1:].shape)
    past = np.full(weights.shape, 1e-2)
    rate = np.array([RATE, *[RATE_PAIRS] * RANK])
    for epoch in range(max(EPOCHS, -(-UPDATES // -(-n // BATCH)))):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            docs = order[at : at + BATCH]
            sizes = starts[docs + 1] - starts[docs]
            begin = np.concatenate([[0], np.cumsum(sizes)])
            part = ids[np.repeat(starts[docs] - begin[:-1], sizes) + np.arange(begin[-1])]
            x = weights[part]
            total = _sums(x, begin)
            square = _sums(np.square(x[:, :, 1:]).sum(2), begin)
            logit = bias + total[:, :, 0] + (np.square(total[:, :, 1:]).sum(2) - square) / 2
            error = (1 / (1 + np.exp(-logit.clip(-30, 30))) - targets[docs]) * heads / len(docs)
            grown = np.repeat(error, sizes, 0)[:, :, None]
            grad = np.concatenate([grown, grown * (np.repeat(total[:, :, 1:], sizes, 0) - x[:, :, 1:])], 2).reshape(len(part), 2 * (1 + RANK))
            distinct, where = np.unique(part, return_inverse=True)
            step = np.stack([np.bincount(where, grad[:, c], len(distinct)) for c in range(grad.shape[1])], 1).astype(float).reshape(-1, 2, 1 + RANK)  # of nothing, bincount makes integers
            step += DECAY * weights[distinct] * heads[:, None]
            past[distinct] += step * step
            weights[distinct] -= rate * step / np.sqrt(past[distinct])
            bias = bias - 0.05 * error.sum(0)
    return Machine(bias, used, weights.reshape(len(used), 2 * (1 + RANK)) * np.repeat(heads, 1 + RANK))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for ids, offsets in features(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            n = len(offsets) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), lists], ["good", "toxic", "ids"])
            at += n


def _meta(docs: DataFrame, name: str):
    return F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Machine:
    """Fit on at most ``max_train`` labelled documents, chosen by the hash of doc_id; of documents that share one, that with the least row key counts."""
    small_batches(docs.sparkSession)
    usable = labels.select("doc_id", F.col("quality").cast("double").alias("good"), F.col("toxic").cast("double").alias("toxic")).where("doc_id IS NOT NULL AND good IS NOT NULL AND toxic IS NOT NULL")
    some = usable.groupBy("doc_id").agg(F.avg("good").alias("good"), F.avg("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    named = docs.select("doc_id", row_key("doc_id", "text").alias("k"), F.col("text").cast("string").alias("text"), _meta(docs, "lang").alias("l"), _meta(docs, "source").alias("s"))
    chosen = named.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.first("good").alias("good"), F.first("toxic").alias("toxic"), F.min(F.struct("k", "text", "l", "s")).alias("d"))  # some and chosen: max_train rows at most
    got = chosen.select("good", "toxic", "d.text", "d.l", "d.s").mapInArrow(_extract, "good double, toxic double, ids array<int>").toArrow()
    if not got.num_rows:
        return fit(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros((0, 2)))
    flat = got["ids"].combine_chunks()
    sizes = np.asarray(flat.value_lengths())
    ids, starts = np.asarray(flat.flatten()), np.concatenate([[0], np.cumsum(sizes)])
    targets = np.stack([np.asarray(got["good"]), np.asarray(got["toxic"])], 1)
    order = np.lexsort((ids[starts[:-1]], sizes, np.add.reduceat(ids, starts[:-1], dtype=np.int64)))  # the same order however the rows arrive
    moved = np.concatenate([[0], np.cumsum(sizes[order])])
    ids = np.concatenate([ids[starts[i] : starts[i + 1]] for i in order])
    del got, flat
    return fit(ids, moved, targets[order])


def scored(docs: DataFrame, model: Machine, name: str = "__quality") -> DataFrame:
    """``docs`` with a struct column ``name`` of (good, toxic), both probabilities; where docs has such a column, the name gets a number."""
    (name,) = fresh(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WIDTH: 4 MB, and 40 bytes for each feature of the training rows

    @F.arrow_udf(T.StructType([T.StructField("good", T.DoubleType()), T.StructField("toxic", T.DoubleType())]))
    def score(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Array:
        machine = shared.value
        parts = [machine.logits(ids, offsets) for ids, offsets in features(text, lang.to_pylist(), source.to_pylist())]
        p = 1 / (1 + np.exp(-np.clip(np.concatenate(parts), -30, 30))) if parts else np.zeros((0, 2))
        return pa.StructArray.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["good", "toxic"])

    return docs.withColumn(name, score(F.col("text").cast("string"), _meta(docs, "lang"), _meta(docs, "source")))


def keep(docs: DataFrame, model: Machine) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    (name,) = fresh(docs, "__quality")
    return scored(docs, model, name).where((F.col(name)["good"] >= 0.5) & (F.col(name)["toxic"] < 0.5)).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = scored(docs, train(docs, table(spark, sf_dir, "labels")), "p").select("doc_id", F.col("p.good").alias("quality_score"), F.col("p.toxic").alias("toxic_score"))
    return marked.withColumn("keep", F.expr("quality_score >= 0.5 AND toxic_score < 0.5"))
