"""Prefix doubling over every position of a corpus, in full.

Positions get ranks by their first bytes. Then positions and their ranks are paired with the ranks that
stand as many bytes further on, the pairs are grouped and ranked anew, and what is unique leaves, until the
ranks stand for strings of the whole length. Nothing is sampled, so each round shuffles a row for every byte
whose string still repeats. suffix_dedup gives the same result with far fewer positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.suffix_dedup import _remove
from tickloom.llm.tables import forget, written
from tickloom.llm.textcodes import Texts, slices, span_hash

#: Bytes that the first ranks stand for, at most.
FIRST = 25


def _positions(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = Texts(part.column("text"))
            sizes = np.maximum(np.diff(texts.offsets) - first + 1, 0)
            doc = np.repeat(np.arange(len(texts)), sizes)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            start = texts.offsets[doc] + place
            rank = span_hash(texts.prefix(), start, start + first).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc)), pa.array(place, pa.int32()), pa.array(rank)], ["id", "place", "rank"])


def _repeating(pairs: DataFrame, name: str) -> DataFrame:
    """(id, place, rank) of the positions whose pair of ranks (x, y) another position has too; equal pairs get equal ranks."""
    pairs = written(pairs, "pairs")
    common = written(pairs.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y", F.xxhash64("x", "y").alias("rank")), "ranks")
    out = written(pairs.join(common, ["x", "y"]).select("id", "place", "rank"), name)
    forget(pairs, common)
    return out


def repeated_bytes_by_doubling(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """id_col, n_removed, n_spans and kept_sha256 of the texts from which something is removed, as suffix_dedup.repeated_bytes has them."""
    source = written(docs.select(F.col(id_col).alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "texts")
    source = written(source.withColumn("id", F.monotonically_increasing_id()).withColumn("tag", F.lit(0)), "numbered")
    reach = length
    while reach > FIRST and reach % 2 == 0:
        reach //= 2
    reach = min(reach, FIRST)
    alive = source.select("id", "text").mapInArrow(lambda it: _positions(it, reach), "id long, place int, rank long")
    alive = _repeating(alive.select("id", "place", F.col("rank").alias("x"), F.lit(0).cast("long").alias("y")), f"first_{reach}")
    while reach < length:
        offset = min(reach, length - reach)
        ahead = alive.select("id", (F.col("place") - offset).alias("place"), F.col("rank").alias("y"))
        longer = _repeating(alive.withColumnRenamed("rank", "x").join(ahead, ["id", "place"]), f"next_{reach + offset}")
        forget(alive)
        alive, reach = longer, reach + offset
    found = alive.groupBy("id").agg(F.collect_list("place").alias("firsts")).withColumn("lasts", F.col("firsts"))
    changed = source.select("id", "tag", "text").join(found, "id").mapInArrow(lambda it: _remove(it, length), "id long, tag int, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return source.select("id", F.col("name").alias(id_col)).join(changed.drop("tag", "kept_text"), "id").drop("id")
