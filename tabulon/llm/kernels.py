"""Vectorised text kernels over Arrow buffers: words, word hashes, word windows, seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space between words: space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
NEXT = np.uint64(0xC2B2AE3D27D4EB4F)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """STEP to the powers 0 to n - 1, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 4096), STEP, np.uint64)
        base[0] = 1
        _powers = np.cumprod(base, dtype=np.uint64)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of `column`; a longer text stands alone and whole."""
    _, offsets = text_buffer(batch.column(column))
    at, rows = 0, batch.num_rows
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), rows)
        yield batch.slice(at, end - at)
        at = end


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, places, data = texts.buffers()
    if len(texts) == 0 or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(places, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each text's range in them (len(offsets))."""
    solid = ~SPACE[data]
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    value = BYTE[data[np.repeat(starts, lengths) + inside]]
    value *= powers(int(lengths.max()))[inside]
    return mix(np.add.reduceat(value, at) + lengths.astype(np.uint64))


def windows(hashes: np.ndarray, ranges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and which of these windows end in their own text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= NEXT
        out += hashes[j : n + j]
    last = np.repeat(ranges[1:], np.diff(ranges))[:n]
    return mix(out + np.uint64(k)), np.arange(n) + k <= last


def shingle_sets(texts: pa.Array, k: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    A text of fewer words has one, its whole word sequence; one without words has none.
    """
    data, offsets = text_buffer(texts)
    if lower:
        data = LOWER[data]
    starts, ends, ranges = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    all_of, _ = windows(hashes, ranges, k)
    for a, b in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(all_of[a : b - k + 1])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for h in hashes[a:b]:
                whole = whole * NEXT + h
            yield mix(whole + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash in every run of w (the last of equal ones); of all, if there are fewer."""
    n = len(hashes)
    if n <= w:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.zeros(0, int)
    view = np.lib.stride_tricks.sliding_window_view(hashes[::-1], w)
    return np.unique(n - 1 - (np.arange(len(view)) + view.argmin(1)))
