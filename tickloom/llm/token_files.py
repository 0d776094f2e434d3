"""Token ids in Huffman-coded files: canonical length-limited codes, independent blocks, checkpoints of bit offsets.

A folder holds `blocks`, files of block records in document order, and `codes`, the code length of every id. Code
lengths come from the counts of all ids, at most MAX_BITS long (package-merge), and are canonical, so lengths alone give the
codes. Each block decodes alone: it has the ids and sizes of its documents, the bit offset of every
CHECKPOINT-th id, and the coded bits. Decoding looks up MAX_BITS bits at a time in one table, from all checkpoints of a
file in step, so that a file is decoded in CHECKPOINT vector steps.

Block record, little-endian: magic `TLHB`, u32 bytes of the record, u32 shard, u32 documents, u64 ids before the block in its
shard, u64 ids, u64 bits, u32 CRC-32 of what follows; then per document i64 id, u8 1 if the id is null, u64 ids; u64 bit
offsets of the checkpoints; the bits, first bit highest, padded to 8 bytes. A line feed ends the record.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.tables import BROADCAST_IDS, bounded_batches, forget, written
from tickloom.llm.terms import span_strings
from tickloom.llm.textcodes import BYTE_CODES, LOWER_CODES, SPACED, Texts, byte_class, slices, span_hash

MAGIC = b"TLHB"
_HEAD = struct.Struct("<4sIIIQQQI")
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")])
#: Longest code in bits; ids may be as many as fit it.
MAX_BITS = 20
#: Ids between two checkpoints, ids after which a block ends with its document, and blocks of a file.
CHECKPOINT, BLOCK_IDS, FILE_BLOCKS = 256, 1 << 16, 32
#: What stands between words that are encoded as one text, and how many they are.
SIGN, LOT = "0", 256
#: Words whose ids a worker keeps.
KNOWN_WORDS = 1 << 21
_LETTER = ~byte_class([(0x41, 0x5A), (0x61, 0x7A)])
_MARK = ~byte_class([(0x2C, 0x2C), (0x2E, 0x2E)])
#: Ids that a tokenizer may have: the table of counts that the driver sees has no more rows.
MOST_IDS = 1 << MAX_BITS


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with at most `limit` bits, by package-merge; counts are positive."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    if n <= 1:
        return np.ones(n, np.int64)
    rank = np.argsort(counts, kind="stable")
    leaves = counts[rank].astype(np.int64)
    merged, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, pairs))
        order = np.argsort(both, kind="stable")
        merged = both[order]
        is_leaf.append(order < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(is_leaf):
        used = int(level[:take].sum())
        lengths[:used] += 1  # the cheapest leaves of a level are those that are used
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[rank] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length and then of id; ids ascend."""
    order = np.argsort(lengths, kind="stable")
    steps = np.left_shift(1, MAX_BITS - lengths[order])
    codes = np.empty(len(lengths), np.int64)
    codes[order] = (np.cumsum(steps) - steps) >> (MAX_BITS - lengths[order])
    return codes


class Coder:
    """Codes of ids. ids ascend; lengths are theirs."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        size = int(ids.max()) + 1 if len(ids) else 0
        self.length, self.code = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.length[ids], self.code[ids] = lengths, canonical_codes(lengths).astype(np.uint64)
        order = np.argsort(lengths, kind="stable")
        spans = np.left_shift(1, MAX_BITS - lengths[order])
        #: What the next MAX_BITS bits begin with: id << 5 | length of its code.
        self.table = np.zeros(1 << MAX_BITS, np.int64)
        self.table[: spans.sum()] = np.repeat((ids[order].astype(np.int64) << 5) | lengths[order], spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
        """Bits of the ids, the bit offset of every CHECKPOINT-th one, and how many bits there are."""
        length = self.length[ids]
        ends = np.cumsum(length)
        at, bits = ends - length, int(ends[-1]) if len(ends) else 0
        word, shift = at >> 6, 64 - (at & 63) - length
        code = self.code[ids]
        head = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
        out = np.zeros((bits + 63) // 64 + 1, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] |= np.bitwise_or.reduceat(head, first)
            over = np.flatnonzero(shift < 0)  # at most one code runs over the end of a word
            out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
        return out[: (bits + 63) // 64].astype(">u8").tobytes(), at[::CHECKPOINT], bits

    def decode(self, words: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """counts[k] ids from bit at[k] of the 64-bit words for each checkpoint k, one after another; all checkpoints advance in step."""
        out = np.zeros((len(at), int(counts.max()) if len(counts) else 0), np.uint32)
        lane = np.argsort(-counts, kind="stable")
        at, left = at[lane].copy(), counts[lane]
        for step in range(out.shape[1]):
            n = int(np.searchsorted(-left, -step))  # lanes that have more than `step` ids come first
            word, shift = at[:n] >> 6, (at[:n] & 63).astype(np.uint64)
            window = (words[word] << shift) | np.where(shift > 0, words[word + 1] >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
            found = self.table[(window >> np.uint64(64 - MAX_BITS)).astype(np.int64)]
            out[lane[:n], step] = found >> 5
            at[:n] += found & 31
        return out[np.arange(out.shape[1]) < counts[:, None]]


def _tokenizer(model: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks fill the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(model)


def _tokenize(batches: Iterator[pa.RecordBatch], model: str, end: int | None) -> Iterator[pa.RecordBatch]:
    tokenizer = _tokenizer(model)
    for batch in batches:
        for part in slices(batch, "text"):
            found = tokenizer.encode_batch(part.column("text").fill_null("").to_pylist(), add_special_tokens=False)
            ids = [np.array(x.ids if end is None else [*x.ids, end], "<u4").tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])


class _Words:
    """Ids of words; each is encoded once. Of more than KNOWN_WORDS words the later ones are not kept."""

    #: By model: a Python worker keeps its words from task to task.
    of_model: dict[str, _Words] = {}

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        sign = tokenizer.encode(SIGN, add_special_tokens=False).ids
        self.sign = sign[0] if len(sign) == 1 else None
        self.codes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted codes, and each one's place in bounds
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def __call__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        own, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        place = np.searchsorted(self.codes, own)
        known = self.codes[np.minimum(place, len(self.codes) - 1)] == own if len(self.codes) else np.zeros(len(own), bool)
        before = None
        if not known.all():
            before = self.codes, self.at, self.bounds, self.ids
            new = np.flatnonzero(~known)
            ids, sizes, at = self._encoded(span_strings(buf, start[first[new]], end[first[new]], None).to_pylist())
            at = at + len(self.bounds) - 1
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(sizes)))
            self.ids = np.concatenate((self.ids, ids))
            self.codes, self.at = np.insert(self.codes, place[new], own[new]), np.insert(self.at, place[new], at)
            place = np.searchsorted(self.codes, own)
        at = self.at[place][inverse]
        out = self._joined(at)
        if len(self.codes) > KNOWN_WORDS and before is not None:
            self.codes, self.at, self.bounds, self.ids = before
        return out

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words one after another, how many each has, and the place of each word among them.

        Many words are encoded as one text, with a sign between that none of them holds.
        """
        plain = [k for k, w in enumerate(words) if SIGN not in w] if self.sign is not None else []
        lots = [plain[lo : lo + LOT] for lo in range(0, len(plain), LOT)]
        alone = sorted(set(range(len(words))).difference(plain))
        ids, sizes, order = [], [], []
        for lot, found in zip(lots, self.tokenizer.encode_batch_fast([f" {SIGN} ".join(words[k] for k in lot) for lot in lots], add_special_tokens=False), strict=True):
            own = np.array(found.ids, np.uint32)
            cuts = np.flatnonzero(own == self.sign)
            if len(cuts) != len(lot) - 1:
                alone += lot
                continue
            ids.append(own[own != self.sign])
            sizes.append(np.diff(np.concatenate(([-1], cuts, [len(own)]))) - 1)
            order += lot
        for found in self.tokenizer.encode_batch([words[k] for k in alone], add_special_tokens=False):
            ids.append(np.array(found.ids, np.uint32))
            sizes.append(np.array([len(found.ids)]))
        place = np.empty(len(words), np.int64)
        place[order + alone] = np.arange(len(words))
        return np.concatenate(ids), np.concatenate(sizes), place

    def _joined(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.bounds[at + 1] - self.bounds[at]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.bounds[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


def _tokenize_words(batches: Iterator[pa.RecordBatch], model: str, end: int | None) -> Iterator[pa.RecordBatch]:
    known = _Words.of_model.get(model) or _Words.of_model.setdefault(model, _Words(_tokenizer(model)))
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):  # known words are copied once a slice
            texts = Texts(part.column("text"))
            words = texts.words(SPACED, BYTE_CODES)
            start, stop = words.start, words.end
            marked = np.flatnonzero((stop - start > 1) & _MARK[texts.buf[stop - 1]] & _LETTER[texts.buf[np.maximum(stop - 2, 0)]])
            start, stop = np.insert(start, marked + 1, stop[marked] - 1), np.insert(stop, marked, stop[marked] - 1)
            code = span_hash(texts.prefix(LOWER_CODES), start, stop)
            signs = np.concatenate(([0], np.cumsum(texts.buf == ord("<"))))
            special = signs[stop] > signs[start]  # special tokens are told apart by case
            code[special] = ~span_hash(texts.prefix(), start[special], stop[special])
            ids, sizes = known(texts.buf, start, stop, code)
            cuts = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(start, texts.offsets)]
            if end is not None:
                ids = np.insert(ids, cuts[1:], end)
                cuts = cuts + np.arange(len(cuts))
            values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(4 * cuts), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
            yield pa.RecordBatch.from_arrays([part.column("id"), values.cast(pa.binary())], ["id", "ids"])


def token_ids(docs: DataFrame, model: str, end: int | None = None, by_word: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (32-bit little-endian) of every text by the tokenizer file `model`, with the id `end` after each text.

    `model` is a path that every executor has. by_word is for tokenizers that drop white space, fold case and end a token
    where letters end: then a worker encodes every word between ASCII white space once, whatever the case of A-Z, and a last stop
    or comma apart from the ASCII letter before it; ids are the same as those of whole texts. Nulls are empty texts; texts are taken whole.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    encode = _tokenize_words if by_word else _tokenize
    return source.mapInArrow(lambda it: encode(it, model, end), "id long, ids binary")


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ids of 16 bits where all of a document are that small, after a byte that says which."""
    for batch in batches:
        out = []
        for one in batch.column("ids"):
            ids = np.frombuffer(one.as_buffer() or b"", "<u4") if one.is_valid else np.zeros(0, "<u4")
            out.append(b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "ids"])


def _wide(one: pa.Scalar) -> np.ndarray:
    data = memoryview(one.as_buffer())
    return np.frombuffer(data[1:], "<u2").astype(np.uint32) if data[0] == 2 else np.frombuffer(data[1:], "<u4")


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for one in batch.column("ids"):
            own = np.bincount(_wide(one), minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
    ids = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts[ids], pa.int64())], ["token", "n"])


def _blocks(batches: Iterator[pa.RecordBatch], ids: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Block records of a task's documents, in their order."""
    from pyspark import TaskContext

    coder, shard, before = Coder(ids, lengths), TaskContext.get().partitionId(), 0
    docs: list[tuple] = []
    parts: list[np.ndarray] = []
    held = 0

    def record() -> pa.RecordBatch:
        nonlocal before, held
        bits, marks, n_bits = coder.encode(np.concatenate(parts))
        body = np.array(docs, _DOC).tobytes() + marks.astype("<u8").tobytes() + bits
        out = _HEAD.pack(MAGIC, _HEAD.size + len(body), shard, len(docs), before, held, n_bits, zlib.crc32(body)) + body
        before, held = before + held, 0
        docs.clear()
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["value"])

    for batch in batches:
        for key, one in zip(batch.column("id").to_pylist(), batch.column("ids"), strict=True):
            parts.append(_wide(one))
            docs.append((key or 0, key is None, len(parts[-1])))
            held += len(parts[-1])
            if held >= BLOCK_IDS:
                yield record()
    if docs:
        yield record()


def write_token_files(tokens: DataFrame, path: str, shards: int | None = None) -> None:
    """Writes id and ids (32-bit little-endian) to `path` in ascending order of id, nulls first; rows of one id by their ids' bytes.

    The documents are dealt by ranges of their order into shards, a task and some files each. An empty table writes codes and no block.
    """
    spark = tokens.sparkSession
    bounded_batches(spark)
    narrow = tokens.select("id", "ids").mapInArrow(_narrow, "id long, ids binary")
    held = written(narrow.withColumn("tie", F.xxhash64("ids")), "tokens")
    counted = held.select("ids").mapInArrow(_count_ids, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy("token")
    rows = counted.limit(MOST_IDS + 1).collect()  # no more rows than the tokenizer has ids
    ids, counts = (np.array([r[k] for r in rows], np.int64) for k in ("token", "n"))
    lengths = code_lengths(counts)
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist(), strict=True)), "token long, bits long").coalesce(1).write.parquet(f"{path}/codes")
    dealt = held.repartitionByRange(shards, "id", "tie") if shards else held.repartitionByRange("id", "tie")
    dealt = dealt.sortWithinPartitions("id", "tie", "ids").select("id", "ids")
    blocks = dealt.mapInArrow(lambda it: _blocks(it, ids, lengths), "value binary")
    blocks.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", FILE_BLOCKS).option("lineSep", "\n").text(f"{path}/blocks")
    forget(held)


def _parse(data: bytes) -> Iterator[tuple]:
    """Shard, ids before, documents, checkpoints and bits of every block record of a file."""
    at = 0
    while at < len(data):
        magic, size, shard, n_docs, before, n, n_bits, crc = _HEAD.unpack_from(data, at)
        body = memoryview(data)[at + _HEAD.size : at + size]
        if magic != MAGIC or len(body) != size - _HEAD.size or zlib.crc32(body) != crc:
            raise ValueError(f"block at byte {at} is damaged")
        docs = np.frombuffer(body, _DOC, n_docs)
        marks = np.frombuffer(body, "<u8", -(-n // CHECKPOINT), n_docs * _DOC.itemsize).astype(np.int64)
        bits = np.frombuffer(body, ">u8", offset=n_docs * _DOC.itemsize + len(marks) * 8).astype(np.uint64)
        yield shard, before, docs, n, marks, bits
        at += size + 1


def _decode(batches: Iterator[pa.RecordBatch], ids: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    coder = Coder(ids, lengths)
    for batch in batches:
        for one in batch.column("content"):
            blocks = list(_parse(one.as_py()))
            if not blocks:
                continue
            bases = np.cumsum([0] + [len(b[5]) for b in blocks])
            words = np.concatenate([b[5] for b in blocks] + [np.zeros(1, np.uint64)])
            marks = np.concatenate([b[4] + 64 * base for b, base in zip(blocks, bases, strict=False)])
            counts = np.concatenate([np.minimum(CHECKPOINT, b[3] - CHECKPOINT * np.arange(len(b[4]))) for b in blocks])
            found = coder.decode(words, marks, counts)
            end = 0
            for shard, before, docs, n, _, _ in blocks:
                own, end = found[end : end + n], end + n
                cuts = np.concatenate(([0], np.cumsum(docs["n"].astype(np.int64))))
                values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(4 * cuts), pa.py_buffer(np.ascontiguousarray(own, "<u4"))]).cast(pa.binary())
                key = pa.array(docs["id"].astype(np.int64), mask=docs["null"] == 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), shard), pa.int32()), key, pa.array(before + cuts[:-1]), values], ["shard", "id", "at", "ids"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """id, start (ids of all documents before) and ids (32-bit little-endian) of every document under `path`.

    Each file is decoded by itself; starts follow from the number of ids of each shard. A damaged block is an error.
    """
    codes = spark.read.parquet(f"{path}/codes").orderBy("token").limit(MOST_IDS).collect()
    ids, lengths = (np.array([r[k] for r in codes], np.int64) for k in ("token", "bits"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/blocks").select("content")
    found = files.mapInArrow(lambda it: _decode(it, ids, lengths), "shard int, id long, at long, ids binary")
    found = written(found, "decoded")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    starts = found.groupBy("shard").agg(F.sum(F.octet_length("ids") / 4).cast("long").alias("n"))
    starts = starts.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if starts.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        starts = F.broadcast(starts)
    return found.join(starts, "shard").select("id", (F.col("base") + F.col("at")).alias("start"), "ids")
