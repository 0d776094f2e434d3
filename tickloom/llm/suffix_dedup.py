"""Removal of byte strings that also occur elsewhere, by prefix doubling over sampled suffixes.

A byte goes if it lies in a string of `length` (400) bytes that also starts at another place. Ranking
every position of a corpus at doubling offsets would shuffle many times its size, so positions are
sampled by content first: of the 100-byte grams inside each 400-byte string the least by hash is the
string's anchor. Equal strings have equal anchors at equal offsets, so nothing is lost.

Ranks then grow as in prefix doubling, and what is unique leaves:
  1. anchors ranked by their 100 bytes;
  2. strings that share an anchor, in blocks of 16 neighbouring starts, ranked by the bytes that all 16
     share (385) and by the bytes that they span (415): a unique core clears a block, and a repeated
     span settles it;
  3. in blocks that are still open, single starts ranked by their 400 bytes.
Ranks are 64-bit hashes of the bytes, grouped by Spark; equal texts are one node throughout.

Strings may be runs of words as well: the same steps on the hashes of words in place of bytes.

Passages shorter than `length` but of `passage` bytes at least are only marked: anchors are sampled as
densely as those need, and a text that shares the core of a block of their starts is marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tables import BROADCAST_IDS, forget, only_ids, written
from tickloom.llm.textcodes import BYTE_CODES, SPACED, Texts, mix64, position_hashes, slices, span_hash

LENGTH, GRAM, BLOCK = 400, 100, 16
#: The gram of a run of words, in words.
WORD_GRAM = 12
#: Bytes of a passage that is marked, which few passages of over 50 words fall below, and the starts in a block of them.
PASSAGE, WIDE = 272, 32
#: Places in a slice of texts, as many as Arrow strings have.
PLACES = 1 << 31
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class _Bytes(Texts):
    """Texts as strings of bytes."""

    def span(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return first, last + 1


class _Words:
    """Texts as strings of words (anything but white space), each by its hash."""

    def __init__(self, column: pa.Array):
        words = Texts(column).words(SPACED, BYTE_CODES)
        self.buf, self.offsets, self.start, self.end = words.code, words.bounds, words.start, words.end

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def prefix(self) -> np.ndarray:
        return position_hashes(self.buf)

    def span(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes from the first word's start to the last one's end."""
        return self.start[first], self.end[last]


def _units(column: pa.Array, words: bool) -> _Bytes | _Words:
    return _Words(column) if words else _Bytes(column)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, from least values up to and from the edges of blocks."""
    n = len(x) - width + 1
    pad = -len(x) % width
    wide = np.concatenate((x, np.full(pad, ~np.uint64(0)))).reshape(-1, width)
    ahead = np.minimum.accumulate(wide, axis=1).ravel()
    back = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class _Grams:
    """The grams of a slice of texts by hash; the lower bits tell them apart, alike in every slice."""

    def __init__(self, texts: _Bytes | _Words, gram: int):
        self.texts, self.gram, self.prefix = texts, gram, texts.prefix()
        at = np.arange(max(0, len(texts.buf) - gram + 1), dtype=np.int64)
        self.packed = (span_hash(self.prefix, at, at + gram) & ~np.uint64(PLACES - 1)) | at.astype(np.uint64)


class _Runs:
    """The anchors of a slice of texts, and for each the run of starts of `length`-byte strings that have it."""

    def __init__(self, grams: _Grams, length: int):
        texts = self.texts = grams.texts
        self.prefix = grams.prefix
        self.anchor = self.first = self.last = self.doc = np.zeros(0, np.int64)
        if len(texts.buf) < length:
            return
        least = (_sliding_least(grams.packed, length - grams.gram + 1) & np.uint64(PLACES - 1)).astype(np.int64)
        sizes = np.maximum(np.diff(texts.offsets) - length + 1, 0)
        whole = np.flatnonzero(sizes)
        start = np.repeat(texts.offsets[whole] - (np.cumsum(sizes[whole]) - sizes[whole]), sizes[whole]) + np.arange(sizes.sum())
        owner = np.repeat(whole, sizes[whole])
        anchor = least[start]
        if len(start):
            fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))
            head = np.flatnonzero(fresh)
            tail = np.append(head[1:], len(start)) - 1
            self.anchor, self.first, self.last, self.doc = anchor[head], start[head], start[tail], owner[head]

    def local(self) -> np.ndarray:
        return self.anchor - self.texts.offsets[self.doc]

    def chosen(self, wanted: list[np.ndarray]) -> np.ndarray:
        """Runs whose anchor, as a place in its text, is wanted there."""
        ends = np.searchsorted(self.doc, np.arange(len(self.texts) + 1))
        local, keep = self.local(), np.zeros(len(self.anchor), bool)
        for i, own in enumerate(wanted):
            keep[ends[i] : ends[i + 1]] = np.isin(local[ends[i] : ends[i + 1]], own)
        return np.flatnonzero(keep)


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values) if x.is_valid else np.zeros(0, np.int64) for x in column]


def _long_list(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int, words: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            units, texts = _units(part.column("text"), words), Texts(part.column("text"))
            runs = _Runs(_Grams(units, gram), length)
            code = span_hash(runs.prefix, runs.anchor, runs.anchor + gram)
            cuts = np.searchsorted(runs.doc, np.arange(len(texts) + 1))
            raw = memoryview(np.ascontiguousarray(texts.buf))
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("tag"),
                    pa.array(np.diff(units.offsets), pa.int64()),
                    pa.array(sha, pa.string()),
                    _long_list(code.view(np.int64), cuts, pa.int64()),
                    _long_list(runs.local(), cuts, pa.int32()),
                ],
                ["id", "tag", "size", "sha", "codes", "places"],
            )


def _block_rows(runs: _Runs, pick: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Run, number and last start of each block of `size` neighbouring starts of the picked runs, counted back from the anchor."""
    near, far = runs.anchor[pick] - runs.last[pick], runs.anchor[pick] - runs.first[pick]
    lo, count = near // size, far // size - near // size + 1
    row = np.repeat(np.arange(len(pick)), count)
    block = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[row]
    return row, block, runs.anchor[pick][row] - size * block


def _blocks(batches: Iterator[pa.RecordBatch], length: int, gram: int, passage: int | None, words: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of starts of strings; those of passages have the number -1 and a core alone."""
    for batch in batches:
        for part in slices(batch, "text"):
            grams, wanted = _Grams(_units(part.column("text"), words), gram), _lists(part.column("places"))
            runs = _Runs(grams, length)
            pick = runs.chosen(wanted)
            row, block, last = _block_rows(runs, pick, BLOCK)
            core = mix64(span_hash(runs.prefix, last, last - BLOCK + 1 + length) ^ block.astype(np.uint64))
            full = (last <= runs.last[pick][row]) & (last - BLOCK + 1 >= runs.first[pick][row])
            span = np.zeros(len(row), np.uint64)
            span[full] = span_hash(runs.prefix, last[full] - BLOCK + 1, last[full] + length) | np.uint64(1)
            doc, place = runs.doc[pick][row], runs.local()[pick][row]
            if passage:
                runs = _Runs(grams, passage)
                pick = runs.chosen(wanted)
                row, number, last = _block_rows(runs, pick, WIDE)
                cores = mix64(span_hash(runs.prefix, last, last - WIDE + 1 + passage) ^ (number + (1 << 20)).astype(np.uint64))
                doc, place, core = np.concatenate((doc, runs.doc[pick][row])), np.concatenate((place, runs.local()[pick][row])), np.concatenate((core, cores))
                block, span = np.concatenate((block, np.full(len(row), -1))), np.concatenate((span, np.zeros(len(row), np.uint64)))
            doc = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(doc), part.column("tag").take(doc), pa.array(place, pa.int32()), pa.array(block, pa.int32()), pa.array(core.view(np.int64)), pa.array(span.view(np.int64))],
                ["id", "tag", "place", "block", "core", "span"],
            )


def _starts(batches: Iterator[pa.RecordBatch], length: int, gram: int, words: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = _units(part.column("text"), words)
            runs = _Runs(_Grams(texts, gram), length)
            ends = np.searchsorted(runs.doc, np.arange(len(texts) + 1))
            local = runs.local()
            first, last, docs = [], [], []
            for i, (places, blocks) in enumerate(zip(_lists(part.column("open_places")), _lists(part.column("open_blocks")), strict=True)):
                if not len(places):
                    continue
                run = ends[i] + np.searchsorted(local[ends[i] : ends[i + 1]], places)
                end = runs.anchor[run] - BLOCK * blocks.astype(np.int64)
                first.append(np.maximum(end - BLOCK + 1, runs.first[run]))
                last.append(np.minimum(end, runs.last[run]))
                docs.append(np.full(len(places), i))
            if not docs:
                continue
            first, last, docs = np.concatenate(first), np.concatenate(last), np.concatenate(docs)
            count = last - first + 1
            row = np.repeat(np.arange(len(docs)), count)
            start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row]
            doc = docs[row]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(doc)),
                    part.column("tag").take(pa.array(doc)),
                    pa.array(start - texts.offsets[doc], pa.int32()),
                    pa.array(span_hash(runs.prefix, start, start + length).view(np.int64)),
                ],
                ["id", "tag", "start", "code"],
            )


def _remove(batches: Iterator[pa.RecordBatch], length: int, words: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            units, texts = _units(part.column("text"), words), Texts(part.column("text"))
            removed, spans, sha, kept = [], [], [], []
            for i, (first, last) in enumerate(zip(_lists(part.column("firsts")), _lists(part.column("lasts")), strict=True)):
                own = texts.buf[texts.offsets[i] : texts.offsets[i + 1]]
                step = np.zeros(len(own) + 1, np.int32)
                base = units.offsets[i]
                begin, end = units.span(base + first.astype(np.int64), base + last.astype(np.int64) + length - 1)
                np.add.at(step, begin - texts.offsets[i], 1)
                np.add.at(step, end - texts.offsets[i], -1)
                gone = np.cumsum(step[:-1]) > 0
                rest = own[~gone].tobytes()
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("tag"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                ["id", "tag", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )


def _texts_of(source: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of nodes (id, tag, ...) with their texts; nodes are broadcast first, as bare ids, if they are few."""
    if nodes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        source = source.join(F.broadcast(nodes.select("id").distinct()), "id", "left_semi")
    return source.join(nodes, ["id", "tag"])


def _repeats(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, passage: int | None = None, words: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """All rows (id, tag, size, sha), the nodes (id, tag, copies), what changes in nodes, and the nodes that share a passage."""
    # a null id takes part as the smallest one; the tag tells apart different texts under one id
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(ids.alias("id"), F.hash(text).alias("tag"), text.alias("text"))
    least = passage or length
    anchored = written(source.mapInArrow(lambda it: _anchors(it, least, gram, words), "id long, tag int, size long, sha string, codes array<long>, places array<int>"), "anchors")
    nodes = written(anchored.groupBy("sha").agg(F.min("id").alias("id"), F.min("tag").alias("tag"), F.count("*").alias("copies")).select("id", "tag", "copies"), "nodes")

    # rank by the anchor's bytes
    each = anchored.where(f"size >= {least}").join(nodes.select("id", "tag"), ["id", "tag"])
    each = each.select("id", "tag", F.explode(F.arrays_zip("codes", "places")).alias("x")).select("id", "tag", F.col("x.codes").alias("code"), F.col("x.places").alias("place"))
    each = written(each, "each_anchor")
    common = written(each.groupBy("code").count().where("count > 1").select("code"), "common_anchors")
    alive = written(each.join(common, "code", "left_semi").groupBy("id", "tag").agg(F.collect_list("place").alias("places")), "alive")
    rows = written(anchored.select("id", "tag", "size", "sha"), "rows")
    forget(each, common, anchored)
    touched = written(_texts_of(source, alive), "touched")
    forget(alive)

    # rank blocks of strings by the bytes that they share and span
    both = written(touched.mapInArrow(lambda it: _blocks(it, length, gram, passage, words), "id long, tag int, place int, block int, core long, span long"), "blocks")
    shared = None
    if passage:
        wide = both.where("block < 0").select("id", "tag", "core")
        known = written(wide.groupBy("core").count().where("count > 1").select("core"), "common_cores")  # by itself, so that the join can split a hot core
        shared = written(only_ids(wide, known, "core").select("id", "tag").distinct(), "shared")
        forget(known)
    blocks = both.where("block >= 0")
    spans = written(blocks.groupBy("core", "span").agg(F.count("*").alias("n"), F.min(F.struct("id", "tag", "place")).alias("first")), "spans")
    cores = spans.groupBy("core").agg(F.sum("n").alias("of_core"), F.count("*").alias("variants"))
    cores = written(cores.where("of_core > 1").select("core", "variants"), "cores")
    pure = F.expr("variants = 1 AND span <> 0")
    settled = F.expr("span <> 0 AND n > 1")
    verdicts = written(spans.join(cores, "core").select("core", "span", "first", settled.alias("settled"), pure.alias("pure")), "verdicts")
    is_first = F.col("first") == F.struct("id", "tag", "place")
    judged = blocks.join(verdicts, ["core", "span"])
    judged = judged.select("id", "tag", "place", "block", "settled", (~F.col("pure") & (~F.col("settled") | is_first)).alias("open"))
    judged = written(judged.where("settled OR open"), "judged")
    forget(both, spans, cores, verdicts)

    # rank the starts of open blocks by their whole bytes
    asked = judged.where("open").groupBy("id", "tag").agg(F.collect_list(F.struct("place", "block")).alias("x"))
    asked = asked.select("id", "tag", F.col("x.place").alias("open_places"), F.col("x.block").alias("open_blocks"))
    starts = touched.select("id", "tag", "text").join(asked, ["id", "tag"]).mapInArrow(lambda it: _starts(it, length, gram, words), "id long, tag int, start int, code long")
    starts = written(starts, "starts")
    again = written(starts.groupBy("code").count().where("count > 1").select("code"), "repeated_starts")
    found = starts.join(again, "code", "left_semi").select("id", "tag", F.col("start").alias("first"), F.col("start").alias("last"))
    end = F.col("place") - F.lit(BLOCK) * F.col("block")
    found = found.unionByName(judged.where("settled").select("id", "tag", (end - F.lit(BLOCK - 1)).alias("first"), end.alias("last")))
    found = found.groupBy("id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("x")).select("id", "tag", F.col("x.first").alias("firsts"), F.col("x.last").alias("lasts"))
    changed = touched.select("id", "tag", "text").join(found, ["id", "tag"])
    changed = changed.mapInArrow(lambda it: _remove(it, length, words), "id long, tag int, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    changed = written(changed, "changed")
    forget(touched, judged, starts, again)
    return rows, nodes, changed, shared


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE) -> DataFrame:
    """What of every text is repeated: id_col, n_bytes, n_removed, n_spans, kept_sha256 and shares_passage.

    Texts are UTF-8 bytes, taken whole; matches lie within one text. Equal texts of `length` bytes or
    more go entirely, each copy. A null text is empty; shorter texts stay as they are. Repeated rows
    are copies of each other and give a row each. Null ids stay null. An empty table gives no rows.
    shares_passage is true if a string of `passage` (at most `length`) bytes also starts elsewhere, and
    false if no string of passage - WIDE + 1 bytes does; nothing is removed for it.
    """
    if not gram < passage - WIDE <= passage <= length:
        raise ValueError("a passage is longer than a gram and a block of starts, and no longer than the strings removed")
    rows, nodes, changed, shared = _repeats(docs, id_col, text_col, length, gram, passage)
    rows = rows.withColumnRenamed("size", "n_bytes")
    own = rows.join(nodes, ["id", "tag"], "left").join(changed.drop("kept_text").dropDuplicates(["id", "tag"]), ["id", "tag"], "left")
    own = own.join(shared.withColumn("shared", F.lit(True)), ["id", "tag"], "left")
    several = F.expr("copies IS NULL OR copies > 1")
    copied = several & (F.col("n_bytes") >= length)
    pick = lambda whole, part, none: F.when(copied, whole).otherwise(F.coalesce(part, none))
    return own.select(
        F.when(F.col("id") != -(1 << 63), F.col("id")).alias(id_col),
        "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(EMPTY_SHA), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
        (F.coalesce("shared", F.lit(False)) | several & (F.col("n_bytes") >= passage)).alias("shares_passage"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None, words: bool = False) -> DataFrame:
    """docs with the repeated bytes cut out of text_col; rows of which nothing is left go, others keep all columns.

    words: length and gram count words, and runs of `length` equal words go, whatever white space parts them; length must be
    gram + BLOCK at least. Of bytes a text of spaces is nothing, of words one of any white space.
    Where a cut splits a character, the rest of that character goes too. Nulls, repeats and empty tables as in repeated_bytes.
    """
    gram = gram or (WORD_GRAM if words else GRAM)
    if length < gram + BLOCK:
        raise ValueError("a string is at least as long as a gram and a block of starts")
    rows, nodes, changed, _ = _repeats(docs, id_col, text_col, length, gram, words=words)
    copies = rows.where(f"size >= {length}").join(nodes, ["id", "tag"], "left").where("copies IS NULL OR copies > 1")
    new = copies.select("id", "tag", F.lit("").alias("kept_text")).unionByName(changed.select("id", "tag", "kept_text"))
    new = written(new.groupBy("id", "tag").agg(F.min("kept_text").alias("kept_text")), "new_texts")
    forget(rows, nodes, changed)
    few = new.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    names = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(
        F.struct(*names).alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.hash(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("tag"),
    )
    keys = new.select("id", "tag")
    same = marked.join(F.broadcast(keys) if few else keys, ["id", "tag"], "left_anti").select("row.*")
    cut = (marked.join(F.broadcast(keys), ["id", "tag"], "left_semi") if few else marked).join(new, ["id", "tag"])
    cut = cut.withColumn("row", F.col("row").withField(f"`{text_col}`", F.col("kept_text"))).where(F.length(F.btrim("kept_text", F.lit(" \t\n\v\f\r" if words else " "))) > 0).select("row.*")
    return same.unionByName(cut)
