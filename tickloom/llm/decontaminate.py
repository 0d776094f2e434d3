"""Benchmark decontamination with suffix arrays of the training text.

Every shard (a run of whole documents) gets a suffix array over its words, built by prefix tripling on
word ranks. Every benchmark suffix is binary-searched in it; the interval found holds all places that
share at least `window` words with the suffix. Suffixes of items that open alike are searched once.
Neighbouring places on one diagonal join into longest verbatim matches with their locations. The work
needs no shuffle. The benchmark is packed into blocks of bounded size; a pass over the documents builds
each suffix array once and searches several blocks in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tables import bounded_batches, written
from tickloom.llm.textcodes import ALNUM, WORD_STEPS, Texts, slices

WINDOW = 10
#: Benchmark text in a block, and the blocks that one pass over the documents carries.
BLOCK_BYTES, PASS_BLOCKS = 2 << 20, 16
#: Windows that are searched, and places by items that are joined, at a time.
SEARCHED, JOINED = 1 << 16, 1 << 20
SPANS = "array<struct<item_id:string,doc_word:long,item_word:long,n_words:long>>"
HITS = {"runs": "array<struct<doc_word:long,n_words:long>>", "items": "array<string>"}


class Suffixes:
    """Sorted suffixes of a word sequence, ordered by their first `depth` words at least."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, depth: int):
        self.vocabulary, ids = np.unique(codes, return_inverse=True)
        docs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.place = np.arange(len(codes)) + docs  # a 0 ends each document
        self.text = np.zeros(len(codes) + len(bounds) - 1 + depth, np.int64)
        self.text[self.place] = ids + 1
        self.word = np.full(len(self.text), -1, np.int64)
        self.word[self.place] = np.arange(len(codes))
        self.doc = np.full(len(self.text), -1, np.int64)
        self.doc[self.place] = docs
        rank, reach = self.text, 1
        while True:  # each round sorts triples of ranks and so trebles the words compared
            tail = np.zeros(2 * reach, np.int64)
            longer = np.concatenate((rank, tail))
            bits = np.uint64(int(rank.max(initial=0)).bit_length())
            n = len(rank)
            if 3 * int(bits) > 63:
                _, pair = np.unique(longer[:n] << np.int64(bits) | longer[reach : reach + n], return_inverse=True)
                key = pair.astype(np.int64) << np.int64(bits) | longer[2 * reach : 2 * reach + n]
            else:
                key = (longer[:n] << np.int64(2 * bits)) | (longer[reach : reach + n] << np.int64(bits)) | longer[2 * reach : 2 * reach + n]
            reach *= 3
            if reach >= depth:
                self.order = np.argsort(key, kind="stable")
                return
            _, rank = np.unique(key, return_inverse=True)
            rank = rank.astype(np.int64)

    def known(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of words in this text, 0 for words that it lacks."""
        if not len(self.vocabulary):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == codes, at + 1, 0)

    def intervals(self, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last place in `order` of the suffixes that begin with each query row."""
        steps = np.arange(queries.shape[1])
        found = []
        for after in (False, True):
            lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.order), np.int64)
            while (lo < hi).any():
                mid = np.minimum((lo + hi) // 2, len(self.order) - 1)
                there = self.text[np.minimum(self.order[mid][:, None] + steps, len(self.text) - 1)]
                differ = (there != queries) & (steps < lengths[:, None])
                first = differ.argmax(1)
                rows = np.arange(len(queries))
                less = differ.any(1) & (there[rows, first] < queries[rows, first])
                less |= after & ~differ.any(1)
                open_ = lo < hi
                lo = np.where(open_ & less, mid + 1, lo)
                hi = np.where(open_ & ~less, mid, hi)
            found.append(lo)
        return found[0], found[1]


class Block:
    """Word codes of some items. A window begins at each of their suffixes that is long enough."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        words = Texts(pa.array([t for _, t in items], pa.string())).words(ALNUM)
        self.ids = pa.array([i for i, _ in items], pa.string())
        self.code, self.bounds, self.window = words.code, words.bounds, window

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, length and item of every window, equal windows together."""
        sizes = np.diff(self.bounds)
        count = np.where(sizes > 0, np.maximum(1, sizes - self.window + 1), 0)
        owner = np.repeat(np.arange(len(sizes)), count)
        start = self.bounds[owner] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(sizes, self.window)[owner]
        value = length.astype(np.uint64)
        padded = np.concatenate((self.code, np.zeros(self.window, np.uint64)))
        for k in range(self.window):
            value += np.where(k < length, padded[start + k], 0) * WORD_STEPS[k]
        order = np.argsort(value, kind="stable")
        start, length, owner, value = start[order], length[order], owner[order], value[order]
        self.heads = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
        return start, length, owner

    def found(self, table: Suffixes, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, word in the table and distinct window of each place where one stands, by text."""
        number = table.known(self.code)
        unknown = np.concatenate(([0], np.cumsum(number == 0)))
        first, long = start[self.heads], length[self.heads]
        asked = np.flatnonzero(unknown[first + long] == unknown[first])
        doc, word, group = [], [], []
        for lo in range(0, len(asked), SEARCHED):
            part = asked[lo : lo + SEARCHED]
            steps = np.minimum(first[part][:, None] + np.arange(self.window), len(number) - 1)
            left, right = table.intervals(number[steps], long[part])
            count = right - left
            place = table.order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)]
            doc.append(table.doc[place])
            word.append(table.word[place])
            group.append(np.repeat(part, count))
        doc, word, group = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, word, group))
        order = np.argsort(doc, kind="stable")
        return doc[order], word[order], group[order]

    def hits(self, table: Suffixes) -> tuple[np.ndarray, ...]:
        """Word in the table and length of each place of a window; and text and item, once for each item with a window in a text.

        Windows that many items share are listed by place once, and by text once, not by place and item.
        """
        start, length, owner = self.windows()
        sizes = np.diff(np.append(self.heads, len(start)))
        doc, word, group = self.found(table, start, length)
        n_items, n_groups = len(self.bounds), max(len(self.heads), 1)
        met = np.unique(doc * n_groups + group)
        pairs, step = [np.zeros(0, np.int64)], max(1, JOINED // max(int(sizes.max(initial=1)), 1))
        for lo in range(0, len(met), step):  # the items of a window are listed for a bounded number of texts at a time
            at_doc, own = met[lo : lo + step] // n_groups, met[lo : lo + step] % n_groups
            count = sizes[own]
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.heads[own], count)
            pairs.append(np.unique(np.repeat(at_doc, count) * n_items + owner[at]))
        pairs = np.unique(np.concatenate(pairs))
        return word, length[self.heads[group]], pairs // n_items, pairs % n_items

    def places(self, table: Suffixes) -> Iterator[tuple[np.ndarray, ...]]:
        """Text, word in the table, item, word of the item and length of each place of a window, about JOINED at a time, texts whole."""
        start, length, owner = self.windows()
        sizes = np.diff(np.append(self.heads, len(start)))
        doc, word, group = self.found(table, start, length)
        if not len(doc):
            return
        total = np.cumsum(sizes[group])
        lo = 0
        while lo < len(doc):
            reach = np.searchsorted(total, (total[lo - 1] if lo else 0) + JOINED, "right")
            hi = np.searchsorted(doc, doc[min(max(reach, lo), len(doc) - 1)], "right" if reach >= len(doc) or doc[reach] == doc[lo] else "left")
            own = group[lo:hi]
            count = sizes[own]
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.heads[own], count)
            yield np.repeat(doc[lo:hi], count), np.repeat(word[lo:hi], count), owner[at], start[at] - self.bounds[owner[at]], length[at]
            lo = hi


def _diagonals(doc, word, owner, offset, length) -> tuple[np.ndarray, ...]:
    """Places on one diagonal of one item and text, in order, join into longest matches: text, item, word, word of the item, words."""
    order = np.lexsort((word, word - offset, owner, doc))
    doc, word, owner, offset, length = (x[order] for x in (doc, word, owner, offset, length))
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (np.diff(doc) != 0) | (np.diff(owner) != 0) | (np.diff(word - offset) != 0) | (np.diff(word) != 1)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(doc)) - 1
    return doc[head], owner[head], word[head], offset[head], word[tail] + length[tail] - word[head]


def _spans(part: pa.RecordBatch, blocks: list[Block], window: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words, hit words and spans of each text; the spans of earlier passes come along in part."""
    words = Texts(part.column("text")).words(ALNUM)
    before = part.column("spans")
    flat = before.flatten()
    docs = [np.repeat(np.arange(len(before)), np.diff(np.asarray(before.offsets)))]
    columns = [[pa.array(flat.field(k)) for k in range(4)]]
    if len(words.code):
        table = Suffixes(words.code, words.bounds, window)
        for block in blocks:
            for places in block.places(table):
                doc, owner, word, offset, size = _diagonals(*places)
                docs.append(doc)
                columns.append([block.ids.take(pa.array(owner)), pa.array(word - words.bounds[doc]), pa.array(offset), pa.array(size)])
    doc = np.concatenate(docs)
    names, at, item_word, size = (pa.concat_arrays([x[k].cast(t) for x in columns]) for k, t in enumerate([pa.string(), pa.int64(), pa.int64(), pa.int64()]))
    order = np.argsort(doc, kind="stable")
    cuts = np.searchsorted(doc[order], np.arange(part.num_rows + 1))
    structs = pa.StructArray.from_arrays([x.take(pa.array(order)) for x in (names, at, item_word, size)], ["item_id", "doc_word", "item_word", "n_words"])
    step = np.zeros(len(words.code) + 1, np.int64)
    begin = np.asarray(at) + words.bounds[doc]
    np.add.at(step, begin, 1)
    np.add.at(step, begin + np.asarray(size), -1)
    hit = _covered(step)[words.bounds]
    return np.diff(words.bounds), np.diff(hit), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), structs)


def _covered(step: np.ndarray) -> np.ndarray:
    """Words hit up to each word, from the number of hits that begin less those that end there."""
    return np.concatenate(([0], np.cumsum(np.cumsum(step[:-1]) > 0)))


def _hits(part: pa.RecordBatch, blocks: list[Block], window: int) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Words, hit words, runs of hit words and distinct items of each text; those of earlier passes come along in part."""
    words = Texts(part.column("text")).words(ALNUM)
    runs, items = part.column("runs"), part.column("items")
    flat, of_run = runs.flatten(), np.repeat(np.arange(len(runs)), np.diff(np.asarray(runs.offsets)))
    step = np.zeros(len(words.code) + 1, np.int64)
    begin = np.asarray(flat.field(0)) + words.bounds[of_run]
    np.add.at(step, begin, 1)
    np.add.at(step, begin + np.asarray(flat.field(1)), -1)
    docs, names = [np.repeat(np.arange(len(items)), np.diff(np.asarray(items.offsets)))], [items.flatten()]
    if len(words.code):
        table = Suffixes(words.code, words.bounds, window)
        for block in blocks:
            word, size, doc, owner = block.hits(table)
            np.add.at(step, word, 1)
            np.add.at(step, word + size, -1)
            docs.append(doc)
            names.append(block.ids.take(pa.array(owner)))
    doc, name = np.concatenate(docs), pa.concat_arrays(names).dictionary_encode()
    code = name.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    kept = order[fresh]
    own = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[fresh], np.arange(part.num_rows + 1)), pa.int32()), name.take(pa.array(kept)).dictionary_decode())
    inside = np.cumsum(step[:-1]) > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = words.bounds[:-1][np.diff(words.bounds) > 0]
    first[heads] = inside[heads]
    last = np.append(inside[:-1] & (~inside[1:] | first[1:]), inside[-1:])
    at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(words.bounds, at, "right") - 1
    found = pa.StructArray.from_arrays([pa.array(at - words.bounds[text], pa.int64()), pa.array(end - at, pa.int64())], ["doc_word", "n_words"])
    cuts = np.searchsorted(at, words.bounds)
    return np.diff(words.bounds), np.diff(_covered(step)[words.bounds]), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found), own


def _search(batches: Iterator[pa.RecordBatch], blocks: list[Block], window: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            if "spans" in names:
                n_words, n_hit, spans = _spans(part, blocks, window)
                own = {"spans": spans}
            else:
                n_words, n_hit, runs, items = _hits(part, blocks, window)
                own = {"runs": runs, "items": items}
            own |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64())}
            yield pa.RecordBatch.from_arrays([own[n] if n in own else part.column(n) for n in names], names)


def _packed(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Items of a partition in rows of about `limit` bytes."""
    for batch in batches:
        size = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        group = np.cumsum(size) // limit
        cuts = np.append(np.searchsorted(group, np.unique(group)), batch.num_rows).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cuts, batch.column(c)) for c in ("item", "text")], ["item", "text"])


def _matched(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, state: dict[str, str]) -> DataFrame:
    """rows (text and any columns but these) with n_words, n_hit and the columns of state: spans, or runs and items."""
    bounded_batches(rows.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    packed = written(items.mapInArrow(lambda it: _packed(it, BLOCK_BYTES), "item array<string>, text array<string>"), "benchmark")
    out, held = rows.withColumns({n: F.array().cast(kind) for n, kind in state.items()}), []

    def one_pass(df: DataFrame, blocks: list[Block], last: bool) -> DataFrame:
        fields = [f for f in df.schema if f.name not in (*state, *(("text",) if last else ()))]
        names = [*(f.name for f in fields), *(("n_words", "n_hit") if last else ()), *state]
        kinds = {f.name: f.dataType.simpleString() for f in fields} | {"n_words": "long", "n_hit": "long"} | state
        return df.mapInArrow(lambda it: _search(it, blocks, window, names), ", ".join(f"`{n}` {kinds[n]}" for n in names))

    for r in packed.toLocalIterator():  # a pass carries a bounded part of the benchmark
        if len(held) == PASS_BLOCKS:
            out, held = written(one_pass(out, held, False), "searched"), []
        held.append(Block(list(zip(r["item"], r["text"], strict=True)), window))
    return one_pass(out, held, True)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Verbatim matches of benchmark items in documents.

    Words are runs of ASCII letters (A-Z as a-z), digits and characters beyond ASCII. Items match by
    windows of `window` words; an item of fewer words, but not none, is one window.
    Returns a row per document: id_col, n_words, n_hit (words inside a match), spans: the longest
    matches as item_id (text), doc_word, item_word and n_words.

    A null or empty text has no words and no match; a null or empty item matches nothing. An item with
    a null id still hits words; its spans have a null item_id. Repeated rows and ids give a row each.
    Empty tables give no rows, or rows without matches.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _matched(rows, benchmark, item_col, item_text_col, window, {"spans": SPANS}).withColumnRenamed("id", id_col)


def matched_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id_col, n_words, n_hit, runs of hit words (doc_word, n_words) and the distinct ids of the items that match, without their places.

    As longest_matches, but what it holds grows with places and with items, not with their product, where many items share a passage.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _matched(rows, benchmark, item_col, item_text_col, window, HITS).withColumnRenamed("id", id_col)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the rows that have a verbatim match, whatever their ids; all columns stay. Texts and items as in longest_matches."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index(text_col)]).cast("string"))
    return _matched(rows, benchmark, item_col, item_text_col, window, HITS).where("n_hit = 0").select(*names).toDF(*docs.columns)
