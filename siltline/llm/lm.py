"""Operator 7: language-model scores of documents by a hashed maximum-entropy model.

The next word's probability is a product over the levels of a tree of classes, each a softmax over ``SIDE`` outcomes: p(class | history) p(class within it | history, class) ... p(word | history, classes). Logits sum hashed weights of
four features of the history: the word before (bigram), the two before (trigram), and the words two and three back alone (skips), above the unigram as bias. Words are in classes by their frequency in the corpus. With
as many levels as the corpus's distinct words need, ``LEVELS`` at most (65,536 outcomes), each word has an outcome of its own; of more, the 61,440 most frequent have, and the rest share 4,096 hashed ones, of which
a word gets the share that its count in the corpus has. All words that the corpus doesn't have share one more occurrence of each such outcome.

Training covers all documents: words are counted over the whole corpus by a shuffle, and in every round each task walks once through all its texts with gradient updates from the common weights;
the tasks' weights are shuffled in blocks of ``ROWS`` rows and averaged by how often a task used the row. An update adds the gradients of all events of a batch that share a row; of rows with more than ``LIMIT`` events the sum is scaled to
``LIMIT`` times their mean, as it diverges otherwise. Scoring is one map over the documents in sparse numpy batches.

Scale: counts and weights gathered grow with the number of tasks, that is with the input; what a task averages is a small part of the blocks. Each feature of each level has a table of as many rows as the corpus may have histories, 2^``BITS`` at most (33 MB for all);
beyond that, histories share rows. Counts of up to ``HELD`` words are broadcast (12 MB); those of rarer words that occur more than once are joined, so that every word has its own.

Defined cases: a null text, or one without a word, has n_words 0 and null scores; repeated rows get equal scores; doc_id may be null; a word is a run of ASCII letters, digits, underscores and all other non-ASCII characters,
lower-cased in ASCII and Latin-1; an empty table gives no rows; further columns are ignored, whatever their names. Scores depend slightly on how the texts fall into tasks, as the order of updates does.

Result: doc_id, n_words, log2_prob, bits_per_word, perplexity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .words import buffers, mix, pieces, word_hashes

SIDE = 16
LEVELS = 4  # at most
BITS = 15  # at most
HELD = 1 << 20
FEATURES = 4
BATCH = 1 << 14
ROWS = 64  # of a block that is shuffled
GROUP = 4  # blocks averaged together
RATE = 0.1
ROUNDS = 1
LIMIT = 8  # times the mean gradient that a row moves by at most in a batch; with 4 features, steps above 10 times can overshoot (the softmax's curvature is at most 1/2)


def history(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit hashes of the features of each word's history, one row for each feature. Histories end at the text's beginning."""
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    back = [np.where(place >= k, np.concatenate([np.zeros(k, np.uint64), words[:-k]])[: len(words)], np.uint64(k)) for k in (1, 2, 3)]
    salts = np.array([0x51ED270B, 0x2545F491, 0x6C62272E, 0x7F4A7C15], np.uint64)
    return np.stack([mix(back[0] + salts[0]), mix(back[0] * np.uint64(0x9E3779B97F4A7C15) + back[1] + salts[1]), mix(back[1] + salts[2]), mix(back[2] + salts[3])])


def add_summed(rows: np.ndarray, index: np.ndarray, change: np.ndarray, used: np.ndarray | None = None) -> None:
    """rows[index] += change where every event counts, also those that share a row; a row's sum is at most ``LIMIT`` times its mean. used: grows by each row's number of events."""
    n = np.bincount(index, minlength=len(rows))
    index, events = index.astype(np.intp), n.take(index)
    if events.max(initial=0) > LIMIT:
        change = change * np.minimum(1, np.float32(LIMIT) / events.astype(np.float32))[:, None]
    for to, by in zip(rows.view(np.complex64).T, change.view(np.complex64).T):  # pairs of numbers at once
        np.add.at(to, index, by)
    if used is not None:
        used += n


class Model:
    tail: DataFrame | None = None  # (h, n) of words that occur more than once and aren't held; stays with the driver

    def __init__(self, words: np.ndarray, counts: np.ndarray, rare: np.ndarray, histories: int = 1 << 62) -> None:
        """words: the hashes of those with an outcome of their own, by falling count; counts: theirs; rare: counts of the shared outcomes, a power of SIDE of them; histories: how many there may be."""
        self.levels = next(n for n in range(1, 9) if SIDE ** (n - 1) == len(rare))
        order = np.argsort(words)
        self.sorted, self.ids, self.top = words[order], order, len(words)
        mass = np.full(SIDE**self.levels, 1e-9)
        mass[: self.top + len(rare)] = np.concatenate([counts, rare]) + 0.1
        self.bias = []
        for n in range(1, self.levels + 1):
            sums = mass.reshape(SIDE**n, -1).sum(1).reshape(-1, SIDE)
            self.bias.append(np.log(sums / sums.sum(1, keepdims=True)).astype(np.float32))
        self.bits = min(BITS, max(8, int(histories - 1).bit_length()))
        self.rows = np.zeros((self.levels * FEATURES << self.bits, SIDE), np.float32)
        self.rare_logs = np.log(rare + 1.0)
        self.hold(np.zeros(0, np.uint64), np.zeros(0))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tail"}

    def hold(self, words: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(words)
        self.held, self.held_logs = words[order], np.log(counts[order]).astype(np.float32)

    def shares(self, words: np.ndarray, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log of each word's share of its outcome, the words whose count isn't held and was taken as 1)."""
        logs = np.zeros(len(words))
        rare = np.flatnonzero(outcome >= self.top)
        logs[rare] = -self.rare_logs[outcome[rare] - self.top]
        if not len(self.held):
            return logs, rare
        at = np.minimum(np.searchsorted(self.held, words[rare]), len(self.held) - 1)
        found = self.held[at] == words[rare]
        logs[rare[found]] += self.held_logs[at[found]]
        return logs, rare[~found]

    def outcomes(self, words: np.ndarray) -> np.ndarray:
        rare = self.top + (words & np.uint64(len(self.rare_logs) - 1)).astype(np.int64)
        if not len(self.sorted):
            return rare
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.ids[at], rare)

    def step(self, outcome: np.ndarray, features: np.ndarray, rate: float = 0.0, used: np.ndarray | None = None) -> np.ndarray:
        """Natural log probabilities of a batch; with a rate, a gradient update follows. used: a count of events for each row, which grows."""
        at = np.arange(len(outcome))
        total = np.zeros(len(outcome), np.float32)
        size = 1 << self.bits
        for level, bias in enumerate(self.bias):
            node = outcome // SIDE ** (self.levels - level)
            target = outcome // SIDE ** (self.levels - 1 - level) % SIDE
            salt = (node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level + 1)) * np.uint64(0xA0761D6478BD642F)
            index = (((features ^ salt) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.uint16)
            first = level * FEATURES * size
            logits = bias.take(node, 0)
            for k in range(FEATURES):
                logits += self.rows[first + k * size : first + (k + 1) * size].take(index[k], 0, mode="clip")
            np.minimum(logits, 80, out=logits)
            p = np.exp(logits)
            norm = p.sum(1, keepdims=True)
            total += logits[at, target] - np.log(norm[:, 0])
            if rate:
                p *= -rate / norm
                p[at, target] += rate
                for k in range(FEATURES):
                    own = slice(first + k * size, first + (k + 1) * size)
                    add_summed(self.rows[own], index[k], p, None if used is None else used[own])
        return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(word_hashes(body, offsets)[0], return_counts=True) for _, _, body, offsets in pieces(*buffers(batch.column(0)))]
        if found:
            distinct, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([f[1] for f in found]), len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(counts)], ["h", "n"])


def _events(model: Model, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for i, j, body, offsets in pieces(*buffers(texts)):
        words, first = word_hashes(body, offsets)
        yield i, j, first, words, model.outcomes(words), history(words, first) if len(words) else np.zeros((FEATURES, 0), np.uint64)


def _train(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        model = None
        for batch in batches:
            if model is None:
                model = copy.copy(shared.value)
                model.rows, used = model.rows.copy(), np.zeros(len(model.rows), np.int64)
            for *_, outcome, features in _events(model, batch.column(0)):
                for a in range(0, len(outcome), BATCH):
                    model.step(outcome[a : a + BATCH], features[:, a : a + BATCH], rate, used)
        if model is not None:
            n, w = used.astype(np.uint32).reshape(-1, ROWS), model.rows.astype(np.float16).reshape(-1, ROWS * SIDE)
            full = np.flatnonzero(n.any(1))
            for a in range(0, len(full), 512):
                part = full[a : a + 512]
                columns = n[part], w[part]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in columns)], ["block", "n", "w"])

    return run


def _average(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, counts = np.zeros((GROUP, ROWS, SIDE)), np.zeros((GROUP, ROWS))
    base = key[0].as_py() * GROUP
    for batch in batches:
        for block, n, w in zip(batch.column("block").to_pylist(), batch.column("n"), batch.column("w")):
            n = np.frombuffer(n.as_buffer(), np.uint32).astype(float)
            sums[block - base] += np.frombuffer(w.as_buffer(), np.float16).reshape(ROWS, SIDE) * n[:, None]
            counts[block - base] += n
    full = np.flatnonzero(counts.any(1))
    mean = (sums / np.maximum(counts, 1)[:, :, None]).astype(np.float16)
    yield pa.RecordBatch.from_arrays([pa.array(full + base, pa.int32()), pa.array([mean[i].tobytes() for i in full], pa.binary())], ["block", "w"])


def train(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """The model of all texts."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    counts = stored(texts.mapInArrow(_count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "word-counts")
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    levels = next((n for n in range(1, LEVELS) if SIDE**n - SIDE ** (n - 1) >= distinct), LEVELS)
    rest = SIDE ** (levels - 1)
    top = counts.orderBy(F.desc("n"), "h").limit(SIDE**levels - rest).toArrow()
    words = np.asarray(top["h"]).view(np.uint64)
    rare = -np.bincount((words & np.uint64(rest - 1)).astype(np.int64), np.asarray(top["n"]), rest)
    for slot, n in counts.groupBy(F.col("h").bitwiseAND(rest - 1).alias("slot")).agg(F.sum("n")).collect():  # of SIDE^(LEVELS - 1) at most
        rare[slot] += n
    model = Model(words, np.asarray(top["n"]), rare, n_words + 3 * distinct)  # at most a trigram for each word, and one history of each other feature for each distinct word
    spark = docs.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        made = texts.mapInArrow(_train(shared, rate), "block int, n binary, w binary")
        mean = made.groupBy(F.expr(f"block div {GROUP}").alias("g")).applyInArrow(_average, "block int, w binary").toArrow()
        shared.destroy()
        if mean.num_rows:
            model.rows.reshape(-1, ROWS * SIDE)[np.asarray(mean["block"])] = np.frombuffer(b"".join(mean["w"].to_pylist()), np.float16).reshape(mean.num_rows, -1)
    size, again = F.floor(F.log2("n") * 16), counts.where("n > 1")
    least, room = None, HELD
    for b, n in sorted(again.groupBy(size.alias("b")).count().collect(), reverse=True):
        room -= n
        if room < 0:
            model.tail = again if least is None else again.where(size < least)
            break
        least = b
    if least is not None:
        held = again.where(size >= least).toArrow()
        model.hold(np.asarray(held["h"]).view(np.uint64), np.asarray(held["n"]))
    return model


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, first, words, outcome, features in _events(model, batch.column(1)):
                logs = [model.step(outcome[a : a + BATCH], features[:, a : a + BATCH]) for a in range(0, len(outcome), BATCH)]
                shares, missing = model.shares(words, outcome)
                sums = np.concatenate([[0.0], np.cumsum(np.concatenate(logs) + shares)]) if logs else np.zeros(1)
                n = np.diff(first)
                total = (sums[first[1:]] - sums[first[:-1]]) / np.log(2)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(missing, first), pa.int32()), pa.array(words[missing].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(total, mask=n == 0), lists], ["doc_id", "n_words", "log2_prob", "missing"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The scores of all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_score(shared), f"doc_id {kind}, n_words bigint, log2_prob double, missing array<bigint>")
    if model.tail is not None:
        out = stored(out.withColumn("row", F.monotonically_increasing_id()), "word-scores")  # written, so that a row keeps its number
        more = out.select("row", F.explode("missing").alias("h")).join(model.tail, "h").groupBy("row").agg(F.sum(F.log2("n")).alias("more"))
        out = out.drop("missing").join(more, "row", "left").withColumn("log2_prob", F.col("log2_prob") + F.coalesce("more", F.lit(0.0)))
    bits = -F.col("log2_prob") / F.col("n_words")
    return out.select("doc_id", "n_words", "log2_prob", F.when(F.col("n_words") > 0, bits).alias("bits_per_word"), F.when(F.col("n_words") > 0, F.pow(F.lit(2.0), bits)).alias("perplexity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs))
