"""Words of texts counted inside tasks before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tickloom.llm.textcodes import mix64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Rows that a task holds before it merges those that are alike.
HELD = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def span_strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray | None = LOWER) -> pa.Array:
    """The bytes of each span as a string, mapped by a table (A-Z as a-z, unless told otherwise); spans must hold whole characters."""
    sizes = end - start
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    data = buf[np.repeat(start - offsets[:-1], sizes) + np.arange(offsets[-1])]
    data = data if table is None else table[data]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal rows together, and where in it each run of equal rows begins.

    Rows are compared by a 64-bit hash of all their keys, so one sort of integers does.
    """
    whole = keys[0].astype(np.uint64)
    for k in keys[1:]:
        whole = mix64(whole * _STEP + k.astype(np.uint64))
    order = np.argsort(whole)
    whole = whole[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = whole[1:] != whole[:-1]
    return order, np.flatnonzero(fresh)


class Numbers:
    """Small numbers for strings, in order of first sight."""

    def __init__(self):
        self.of: dict[str, int] = {}

    def __call__(self, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode()
        own = np.array([self.of.setdefault(x, len(self.of)) for x in coded.dictionary.to_pylist()] or [0], np.int64)
        return own[coded.indices.to_numpy(zero_copy_only=False)]

    def names(self, numbers: np.ndarray) -> pa.Array:
        return pa.array(list(self.of), pa.large_string()).take(pa.array(numbers))


class Lexicon:
    """The string behind every word code that a task has met since it was last cleared."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self._codes: list[np.ndarray] = []
        self._words: list[pa.Array] = []

    def add(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> None:
        codes, first = np.unique(code, return_index=True)
        self._codes.append(codes)
        self._words.append(span_strings(buf, start[first], end[first]))

    def words(self, codes: np.ndarray) -> pa.Array:
        known, first = np.unique(np.concatenate(self._codes), return_index=True)
        words = pa.chunked_array(self._words).take(pa.array(first)).combine_chunks()
        self._codes, self._words = [known], [words]
        return words.take(pa.array(np.searchsorted(known, codes)))


class Held:
    """Rows of integers with counts; rows with equal keys are merged whenever too many are held."""

    def __init__(self, keys: int, limit: int = HELD):
        self.keys, self.limit = keys, limit
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.rows += len(columns[0])

    def full(self) -> bool:
        """Whether the rows are to be handed on: many are left even when merged."""
        return self.rows > self.limit and self.merge() > self.limit // 2

    def merge(self) -> int:
        if len(self.parts) > 1:
            columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            order, at = runs_of(*columns[: self.keys])
            kept = [c[order[at]] for c in columns[: self.keys]]
            self.parts = [(*kept, *(np.add.reduceat(c[order], at) if len(at) else c[:0] for c in columns[self.keys :]))]
            self.rows = len(at)
        return self.rows

    def take(self) -> tuple[np.ndarray, ...] | None:
        """The merged rows, no longer held."""
        self.merge()
        out, self.parts, self.rows = (self.parts[0] if self.parts else None), [], 0
        return out


def chunks(batch: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def seeded(code: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Codes told apart by a second code, such as that of a language."""
    return mix64(code + seed * _STEP)
