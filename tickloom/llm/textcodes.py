"""Numpy helpers that work on the bytes of many texts at once.

A batch of texts is one byte buffer with offsets, as Arrow stores it. Words, shingles and byte
windows get 64-bit polynomial hashes out of one prefix sum, so no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of text that one numpy pass takes at a time; a longer text is a pass of its own.
SLICE_BYTES = 256 << 10

_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: The same codes with A-Z read as a-z.
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[65:91] = BYTE_CODES[97:123]
WORD_STEPS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _ladder(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to exponent n at least."""
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + (SLICE_BYTES >> 2))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """Byte buffer and offsets of a slice of texts; nulls are empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.large_string())
        n, at = len(column), column.offset
        _, offsets, data = column.buffers()
        raw = np.frombuffer(offsets, np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.buf, self.offsets = whole[raw[0] : raw[-1]], raw - raw[0]
        if column.null_count:
            sizes = np.diff(self.offsets)
            null = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
            if sizes[null].any():  # bytes under a null do not count
                self.buf = self.buf[np.repeat(~null, sizes)]
                sizes = np.where(null, 0, sizes)
            self.offsets = np.concatenate(([0], np.cumsum(sizes)))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def prefix(self, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
        return position_hashes(codes[self.buf])

    def words(self, is_word: np.ndarray, codes: np.ndarray = LOWER_CODES) -> Words:
        return Words(self, is_word, codes)


def position_hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial of the codes, out of which span_hash takes spans."""
    power, _ = _ladder(len(codes))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end): equal for equal bytes, wherever they stand."""
    _, inverse = _ladder(len(prefix))
    return mix64((prefix[end] - prefix[start]) * inverse[start])


class Words:
    """Byte spans and hashes of the words of a slice; bounds[i]:bounds[i+1] are the words of text i."""

    def __init__(self, texts: Texts, is_word: np.ndarray, codes: np.ndarray):
        inside = is_word[texts.buf]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = np.diff(texts.offsets) > 0
        heads, tails = texts.offsets[:-1][full], texts.offsets[1:][full] - 1
        first[heads] = inside[heads]
        last[tails] = inside[tails]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, texts.offsets)
        self.code = span_hash(texts.prefix(codes), self.start, self.end)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of n words inside one text."""
        total = len(self.code) - n + 1
        if total <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        value = np.zeros(total, np.uint64)
        for k in range(n):
            value += self.code[k : k + total] * WORD_STEPS[k]
        keep = np.ones(total, bool)
        for k in range(1, n):  # runs that begin k words before a text's end leave it
            edge = self.bounds[1:] - k
            keep[edge[(edge >= 0) & (edge < total)]] = False
        at = np.flatnonzero(keep)
        return at, mix64(value[at])


def byte_class(separators: list[tuple[int, int]]) -> np.ndarray:
    """Table of the bytes that belong to words: all but those in the closed ranges."""
    out = np.ones(256, bool)
    for lo, hi in separators:
        out[lo : hi + 1] = False
    return out


#: Words are runs of anything but white space.
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of digits, ASCII letters and anything beyond ASCII; A-Z counts as a-z.
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most `rows` rows with about `limit` bytes of text each."""
    if not batch.num_rows:
        return
    sizes = batch.column(column)
    sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(sizes).to_numpy(zero_copy_only=False), float)).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    lo = 0
    for hi in [*cuts.tolist(), batch.num_rows]:
        for at in range(lo, hi, rows):
            yield batch.slice(at, min(rows, hi - at))
        lo = hi
