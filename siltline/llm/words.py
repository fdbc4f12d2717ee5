"""Hashes of all words of a batch of texts, by numpy over the UTF-8 bytes and without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19  # bytes hashed at once, so that the arrays stay in cache; a longer text is a piece of its own
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n + 1:
        size = max(n + 1, PIECE + (PIECE >> 2))
        for name, base in (("p", _BASE), ("i", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POW[name] = np.multiply.accumulate(steps)
    return _POW["p"], _POW["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit counts."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(body: np.ndarray, offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole texts: (first text, end text, bytes, offsets)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lowered(body: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of Latin-1 letters in UTF-8."""
    low = _LOWER[body]
    if len(low) > 1:
        low[1:][(body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)] += 0x20
    return low


def spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word, and for each text the index of its first word (with the number of words at the end)."""
    inside = np.zeros(len(body) + 2, bool)
    inside[1:-1] = WORD[body]
    cut = np.zeros(len(body) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(body: np.ndarray, offsets: np.ndarray, lower: bool = True, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hash of each word, for each text the index of its first word), and a hash of each word's first n bytes for n in prefixes.

    A word is a run of letters, digits and underscores."""
    starts, ends, first = spans(body, offsets)
    power, inverse = _powers(len(body))
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((lowered(body) if lower else body).astype(np.uint64) * power[: len(body)], out=total[1:])
    begun, back = total[starts], inverse[starts]
    more = [mix((total[np.minimum(ends, starts + n)] - begun) * back + np.uint64(n)) for n in prefixes]
    return mix((total[ends] - begun) * back), first, *more
