"""Quality rules from repetition coverage.

Rolling hashes of runs of words, for several run lengths, show which runs occur again in the same
text; the rules bound the share of characters inside such runs and inside repeated lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tables import bounded_batches
from tickloom.llm.textcodes import BYTE_CODES, SPACED, Texts, mix64, slices, span_hash

#: Largest share of word characters inside repeated runs of n words, by n.
RUN_LIMITS = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
#: Largest share of word characters in lines that occur again.
LINE_LIMIT = 0.40
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 20, 8, 30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _again(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each code occurs again in its text, and whether it is a later occurrence."""
    key = mix64(code ^ mix64(owner.astype(np.uint64) + np.uint64(1)))
    _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return count[inverse] > 1, first[inverse] != np.arange(len(code))


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[cuts[1:]] - total[cuts[:-1]]


def _measure(batches: Iterator[pa.RecordBatch], runs: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = Texts(part.column("text"))
            words = texts.words(SPACED, BYTE_CODES)
            points = np.concatenate(([0], np.cumsum((texts.buf & 0xC0) != 0x80, dtype=np.int64)))
            chars = points[words.end] - points[words.start]
            owner = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
            marks = np.concatenate(([0], np.cumsum(SYMBOLS[texts.buf], dtype=np.int64)))
            covered, repeat_words = {}, None
            for n in sorted({*runs, BASE_WINDOW}):
                at, code = words.runs(n)
                again, _ = _again(owner[at], code)
                step = np.zeros(len(words.code) + 1, np.int64)
                np.add.at(step, at[again], 1)
                np.add.at(step, at[again] + n, -1)
                inside = np.cumsum(step[:-1]) > 0
                covered[n] = _sums(np.where(inside, chars, 0), words.bounds)
                if n == BASE_WINDOW:
                    repeat_words = _sums(inside, words.bounds)
            # lines: the breaks inside texts and the ends of texts
            breaks = np.flatnonzero(texts.buf == 10)
            inner = np.searchsorted(breaks, texts.offsets)
            at_text = np.repeat(np.arange(len(texts)), np.diff(inner))
            start = np.concatenate((texts.offsets[:-1], breaks + 1))
            line_owner = np.concatenate((np.arange(len(texts)), at_text))
            order = np.lexsort((np.concatenate((np.zeros(len(texts), np.int8), np.ones(len(breaks), np.int8))), start, line_owner))
            start, line_owner = start[order], line_owner[order]
            end = np.append(start[1:] - 1, 0)
            last = np.append(line_owner[1:] != line_owner[:-1], True)[: len(start)]
            end = np.where(last, texts.offsets[1:][line_owner], end[: len(start)])
            in_line = np.searchsorted(words.start, end) - np.searchsorted(words.start, start)
            full = in_line > 0
            start, end, line_owner = start[full], end[full], line_owner[full]
            again, later = _again(line_owner, span_hash(texts.prefix(), start, end))
            cuts = np.searchsorted(line_owner, np.arange(len(texts) + 1))
            reach = np.concatenate(([0], np.cumsum(chars)))
            line_chars = reach[np.searchsorted(words.start, end)] - reach[np.searchsorted(words.start, start)]
            total = _sums(chars, words.bounds)
            share = lambda x, t=total: pa.array(x / np.maximum(t, 1), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    *(pa.array(x, pa.int64()) for x in (np.diff(words.bounds), total, marks[texts.offsets[1:]] - marks[texts.offsets[:-1]], _sums(later, cuts), repeat_words)),
                    share(_sums(np.where(again, line_chars, 0), cuts)),
                    *(share(covered[n]) for n in runs),
                ],
                ["id", *_COUNTS, "line_share", *(f"run{n}_share" for n in runs)],
            )


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Counts, shares of repeated characters and a verdict for every document.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line_share,
    run<n>_share for each run length, base_failed (under 20 words, or over 30 % of the words in
    repeated windows of 8) and kept: not base_failed, and no share beyond its limit.

    Words are runs without white space, as written. A null or empty text has zero counts and shares
    and fails. Repeated rows give a row each; an empty table gives no rows; texts are taken whole.
    """
    limits = run_limits or RUN_LIMITS
    runs = tuple(sorted(limits))
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    columns = [f"id {kind}", *(f"{c} long" for c in _COUNTS), "line_share double", *(f"run{n}_share double" for n in runs)]
    found = source.mapInArrow(lambda it: _measure(it, runs), ", ".join(columns))
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words")
    within = F.col("line_share") <= line_limit
    for n in runs:
        within &= F.col(f"run{n}_share") <= limits[n]
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & within).withColumnRenamed("id", id_col)
