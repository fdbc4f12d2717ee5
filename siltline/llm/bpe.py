"""Operator 2: BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over 16 bytes cuts each text into chunks of about 2048 bytes whose borders depend on the bytes around them alone, so
passages that documents share make equal chunks. A worker process encodes each different chunk once and keeps the result, across documents, batches and tasks, in a cache of bounded size
(which changes the time and never the result). Chunk joins are then repaired: the text between the last point of the left chunk and the first point of the right one at which any
tokenization must break is encoded again. Such points are single blanks between two other characters and the comma or full stop after an ideograph, where the pre-tokenizer always starts a new piece (a
vocabulary whose pre-tokenizer doesn't is noticed, and its texts are encoded whole). Where a chunk has no such point, the repair grows over it
until both sides agree, over the whole text if need be. The ids are exactly those of encoding the whole text.

Scale: one map over the documents; nothing is shuffled and nothing collected. ``tokenizer`` names a file of ranks (base64 and rank on each line) and ``pattern`` its pre-tokenizer; the file is opened by each worker, never copied.

Defined cases: a null text gives null ids; an empty one none; repeated rows give equal rows; doc_id may be null or repeated; text
of special tokens is ordinary text; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .words import PIECE, _powers, buffers, mix, pieces

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW = 16
CHUNK_BITS = 11
CACHE_BYTES = 48 << 20

_OPEN: dict[tuple[str, str], Codec] = {}
_SOLID = np.zeros(256, bool)  # bytes that surely aren't of white space: ASCII signs, and the first bytes of characters of blocks without any
_SOLID[[*range(33, 127), *range(0xC3, 0xE1), *range(0xE4, 0xF0)]] = True
_BREAKS = ("a b", "1 2", "! ?", "a 1", "é x", "字 ，", "字，字", "字。1", "x' s", "ñ 'll", "字、 字")  # before the blank, or else after the first character


def cuts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The borders of the chunks of all texts, among them the texts' own. A border is never inside a character."""
    n = len(body) - WINDOW
    if n < 1:
        return np.unique(offsets)
    power, inverse = _powers(len(body))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(body.astype(np.uint64) * power[: len(body)])])
    rolling = (total[WINDOW:-1] - total[: -WINDOW - 1]) * inverse[:n]
    at = np.flatnonzero(mix(rolling) & np.uint64((1 << CHUNK_BITS) - 1) == 0) + WINDOW
    text = np.searchsorted(offsets, at, "right") - 1
    at = at[at - offsets[text] >= WINDOW]  # the window is inside the text
    for _ in range(3):
        at = at + ((body[np.minimum(at, len(body) - 1)] & 0xC0) == 0x80) * (at < len(body))
    return np.unique(np.concatenate([at, offsets]))


def points(body: np.ndarray) -> np.ndarray:
    """Where any tokenization must break: before a single blank between two other characters, and before a comma or full stop after an ideograph."""
    if len(body) < 3:
        return np.zeros(0, np.int64)
    blank = np.flatnonzero((body[1:-1] == 32) & _SOLID[body[2:]]) + 1
    lead = blank - 1  # the first byte of the character before
    for _ in range(3):
        lead = lead - ((body[lead] & 0xC0) == 0x80) * (lead > 0)
    blank = blank[_SOLID[body[lead]]]
    wide = np.flatnonzero((body[3:-2] == 0xE3) & (body[4:-1] == 0x80) & ((body[5:] == 0x81) | (body[5:] == 0x82)) | (body[3:-2] == 0xEF) & (body[4:-1] == 0xBC) & (body[5:] == 0x8C)) + 3 if len(body) > 5 else np.zeros(0, np.int64)
    wide = wide[(body[wide - 3] >= 0xE5) & (body[wide - 3] <= 0xE8)]
    return np.sort(np.concatenate([blank, wide]))


class Codec:
    """Ranks of one file, with the cache of chunks."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        flat = bytearray(int(self.begins[-1]))
        for token, rank in ranks.items():
            flat[self.begins[rank] : self.begins[rank + 1]] = token
        self.flat = np.frombuffer(bytes(flat), np.uint8)
        whole = self.encoding.encode_ordinary
        places = [(x, x.find(" ") if " " in x else 1) for x in _BREAKS]
        self.breaks = all(whole(f"w{x}w") == whole(f"w{x[:i]}") + whole(f"{x[i:]}w") for x, i in places)
        self.young: dict[bytes, np.ndarray] = {}
        self.old: dict[bytes, np.ndarray] = {}
        self.held = 0
        self.encoded = 0  # chunks and repairs that were encoded, for tests

    @staticmethod
    def of(path: str, pattern: str = PATTERN) -> Codec:
        if (path, pattern) not in _OPEN:
            _OPEN[path, pattern] = Codec(path, pattern)
        return _OPEN[path, pattern]

    def ids(self, chunk: bytes) -> np.ndarray:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                self.encoded += 1
                found = self.encoding.encode_to_numpy(chunk.decode(), disallowed_special=()).astype(np.int32)
            self.young[chunk] = found
            self.held += len(chunk) + found.nbytes + 200
            if self.held > CACHE_BYTES:
                self.old, self.young, self.held = self.young, {}, 0
        return found

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, for each text the index of its first)."""
        borders = cuts(body, offsets) if self.breaks else np.unique(offsets)
        point = points(body)
        low, high = np.searchsorted(point, borders[:-1] + 4), np.searchsorted(point, borders[1:] - 4, "right")  # of which all bytes are in the chunk
        last_chunk = np.searchsorted(borders, offsets)
        raw, out, ends, made = body.tobytes(), [], [0], 0
        for k in range(len(offsets) - 1):
            pending, parts = int(offsets[k]), []
            a, b = int(last_chunk[k]), int(last_chunk[k + 1])
            for c in range(a, b):
                start, end = int(borders[c]), int(borders[c + 1])
                if b == a + 1:
                    parts.append(self.ids(raw[start:end]))
                    break
                if low[c] >= high[c] and (c < b - 1 or pending < start):
                    if c == b - 1:
                        parts.append(self.ids(raw[pending:end]))
                    continue
                ids = self.ids(raw[start:end])
                sums = np.cumsum(self.lengths[ids])
                first, last = (int(point[low[c]]), int(point[high[c] - 1])) if low[c] < high[c] else (start, start)
                i, j = 0, len(ids)
                if c > a:
                    parts.append(self.ids(raw[pending:first]))
                    i = int(np.searchsorted(sums, first - start)) + 1
                if c < b - 1:
                    j = int(np.searchsorted(sums, last - start)) + 1
                    pending = last
                parts.append(ids[i:j])
            made += sum(map(len, parts))
            out += parts
            ends.append(made)
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(ends)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.begins[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            null = np.asarray(batch.column(1).is_null())
            for i, j, body, offsets in pieces(*buffers(batch.column(1)), PIECE):
                ids, first = codec.encode(body, offsets)
                back = codec.decode(ids)
                sums = np.concatenate([[0], np.cumsum(codec.lengths[ids])])
                if len(back) == len(body):
                    wrong = np.concatenate([[0], np.cumsum(back != body)])
                    same = (sums[first] == offsets)[1:] & (wrong[offsets[1:]] == wrong[offsets[:-1]])
                else:
                    same = np.array([np.array_equal(back[sums[first[k]] : sums[first[k + 1]]], body[offsets[k] : offsets[k + 1]]) for k in range(j - i)])
                gone = null[i:j]
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=pa.array(gone))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array(np.diff(first).astype(np.int32), mask=gone), pa.array(same, mask=gone)], ["doc_id", "token_ids", "n_tokens", "round_trip"])

    return run


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip): the ids of each text, and whether decoding them gives its bytes back."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_encode(tokenizer, pattern), f"doc_id {kind}, token_ids array<int>, n_tokens int, round_trip boolean")


def decoded(tokens: DataFrame, tokenizer: str = TOKENIZER, ids: str = "token_ids", name: str = "text") -> DataFrame:
    """``tokens`` with a column of the text of its ids; null ids give null. Bytes that are no UTF-8 (a cut character) become U+FFFD."""

    @F.arrow_udf(T.StringType())
    def text(lists: pa.Array) -> pa.Array:
        codec = Codec.of(tokenizer)
        return pa.array([None if not x.is_valid else codec.decode(np.asarray(x.values, np.int64)).tobytes().decode(errors="replace") for x in lists], pa.string())

    return tokens.withColumn(name, text(F.col(ids).cast("array<int>")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
