"""Phrases that hold together, by language: multikey three-way quicksort of suffix pointers.

A suffix pointer is the place of a word together with the words after it, up to the greatest depth. A sketch
counts all pairs and triples of words by some bits of their hashes; what shares its bits with too few cannot be frequent and
is abandoned where it stands, so only the rest is shuffled. Equal pointers are merged with their number and
routed by language and their two leading words, so that all pointers that share a phrase meet in one task. There they are sorted
word by word in three parts, below, equal to and above a pivot: an equal part holds one phrase and its
size is the phrase's count; parts that are too small are not sorted further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.tables import bounded_batches, forget, written
from tickloom.llm.terms import HELD, Held, Lexicon, Numbers, chunks, runs_of, seeded
from tickloom.llm.textcodes import Texts, byte_class, mix64, slices

#: Words are runs of anything but space and tab, inside pieces.
WORD = byte_class([(0x09, 0x0D), (0x20, 0x20), (0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)])
#: Bytes that end a piece.
ENDS = ~byte_class([(0x0A, 0x0D), (0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)])
#: Binary logarithm of the most bits of the filter, and of the bits of one piece of it. Pairs and triples that a task sketches at a time.
FILTER_BITS, PIECE_BITS, SKETCHED = 28, 16, 1 << 22
#: A pair of words with more than one in so many of all words is hot; there are at most so many of them.
HOT_SHARE = 1024
#: Parts that the pointers of a hot pair are dealt into, by their third word.
HOT_PARTS = 64
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each slice: its words, the language of each word, and whether the next word follows in the same piece."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts = Texts(part.column("text"))
            words = texts.words(WORD)
            if not len(words.code):
                continue
            owner = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
            ends = np.concatenate(([0], np.cumsum(ENDS[texts.buf])))
            joined = np.zeros(len(owner), bool)
            joined[:-1] = (owner[1:] == owner[:-1]) & (ends[words.start[1:]] == ends[words.end[:-1]])
            yield texts, words, part.column("lang"), owner, joined


def _language_codes(column: pa.Array) -> np.ndarray:
    coded = column.dictionary_encode()
    return np.array([xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()] or [0], np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]


_COUNTED = "lang string, w1 string, n long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    languages, lexicon, held = Numbers(), Lexicon(), Held(2)

    def flush() -> Iterator[pa.RecordBatch]:
        lang, code, n = held.take()
        yield from chunks(pa.RecordBatch.from_arrays([languages.names(lang), lexicon.words(code), pa.array(n)], ["lang", "w1", "n"]))
        lexicon.clear()

    for texts, words, lang, owner, _ in _pieces(batches):
        own = languages(lang)[owner]
        order, at = runs_of(own, words.code)
        held.add(own[order[at]], words.code[order[at]], np.diff(np.append(at, len(order))))
        lexicon.add(texts.buf, words.start, words.end, words.code)
        if held.full():
            yield from flush()
    if held.rows:
        yield from flush()


def _phrase_codes(words, lang: pa.Array, owner: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of words that another follows in their piece, codes of these pairs, where a third follows, and codes of those triples."""
    i = np.flatnonzero(joined)
    pair = mix64(seeded(words.code[i], _language_codes(lang)[owner[i]]) * _PAIR + words.code[i + 1])
    deep = np.flatnonzero(joined[i + 1])
    return i, pair, deep, mix64(pair[deep] * _PAIR + words.code[i[deep] + 2])


def _packed(spots: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending spots as gaps of a byte each; a gap of 255 and count 0 carries on."""
    gaps = np.diff(spots, prepend=0)
    more = gaps // 255
    ends = np.cumsum(more + 1) - 1
    gap, count = np.full(ends[-1] + 1, 255, np.uint8), np.zeros(ends[-1] + 1, np.uint8)
    gap[ends], count[ends] = gaps % 255, np.minimum(counts, 255)
    return gap.tobytes(), count.tobytes()


_SKETCHED = "piece int, gaps binary, counts binary, code long, n long"


def _sketch(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of all pairs and triples by the leading bits of their codes, and the codes of pairs that are hot in a flush."""
    pairs: list[np.ndarray] = []
    triples: list[np.ndarray] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        pair = np.sort(np.concatenate(pairs))
        at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        n = np.diff(np.append(at, len(pair)))
        hot = n > len(pair) // HOT_SHARE
        rows = [(-1, None, None, c, k) for c, k in zip(pair[at[hot]].view(np.int64).tolist(), n[hot].tolist(), strict=True)]
        spots = (np.sort(np.concatenate((pair, *triples))) >> np.uint64(64 - bits)).astype(np.int64)
        at = np.flatnonzero(np.append(True, spots[1:] != spots[:-1]))
        counts, spots = np.diff(np.append(at, len(spots))), spots[at]
        cuts = np.flatnonzero(np.append(True, spots[1:] >> PIECE_BITS != spots[:-1] >> PIECE_BITS)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(spots)], strict=True):
            rows.append((int(spots[lo]) >> PIECE_BITS, *_packed(spots[lo:hi] & (1 << PIECE_BITS) - 1, counts[lo:hi]), None, None))
        pairs.clear()
        triples.clear()
        columns = zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["piece", "gaps", "counts", "code", "n"])

    for _, words, lang, owner, joined in _pieces(batches):
        _, pair, _, triple = _phrase_codes(words, lang, owner, joined)
        if len(pair):
            pairs.append(pair)
            triples.append(triple)
            held += len(pair) + len(triple)
        if held > SKETCHED:
            yield from flush()
            held = 0
    if held:
        yield from flush()


def _merge_sketches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A bitmap of the spots of each piece that were counted `least` times or more; all of a piece is in one task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        pieces = batch.column("piece").to_pylist()
        for k, piece in enumerate(pieces):
            if piece < 0:
                continue
            own = total.setdefault(piece, np.zeros(1 << PIECE_BITS, np.int64))
            gap, count = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint8) for c in ("gaps", "counts"))
            spot, real = np.cumsum(gap, dtype=np.int64), count > 0
            own[spot[real]] += count[real]
        alone = np.flatnonzero(np.array(pieces) < 0)
        if len(alone):
            mine = batch.take(pa.array(alone))
            yield pa.RecordBatch.from_arrays([mine.column("piece"), pa.nulls(len(alone), pa.binary()), mine.column("code"), mine.column("n")], ["piece", "bits", "code", "n"])
    for piece, own in total.items():
        bits = np.packbits(own >= min(least, 255), bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([bits], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], ["piece", "bits", "code", "n"])


def _passes(table: np.ndarray, bits: int, code: np.ndarray) -> np.ndarray:
    spot = (code >> np.uint64(64 - bits)).astype(np.int64)
    return (table[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


_POINTERS = "lang string, w1 string, w2 string, w3 string, part int, n long"


def _pointers(batches: Iterator[pa.RecordBatch], table: np.ndarray, bits: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Suffix pointers of two and three words that may be frequent, merged; part is not 0 for those of hot pairs."""
    languages, lexicon = Numbers(), Lexicon()
    held = Held(5, 2 * HELD)  # language, first, second and third word (0: none), part

    def flush() -> Iterator[pa.RecordBatch]:
        rows = held.take()
        near = np.argsort(rows[1])  # pointers of one leading word lie together, which packs well
        lang, a, b, c, part, n = (x[near] for x in rows)
        third = np.flatnonzero(c != 0)
        word = lexicon.words(np.concatenate((a, b, c[third])))
        at = np.full(len(c), -1)
        at[third] = np.arange(len(third)) + 2 * len(a)
        columns = [languages.names(lang), word.slice(0, len(a)), word.slice(len(a), len(a)), word.take(pa.array(at, mask=at < 0)), pa.array(part, pa.int32()), pa.array(n)]
        yield from chunks(pa.RecordBatch.from_arrays(columns, ["lang", "w1", "w2", "w3", "part", "n"]))
        lexicon.clear()

    none = np.uint64(0)
    for texts, words, lang, owner, joined in _pieces(batches):
        i, pair, deep, triple = _phrase_codes(words, lang, owner, joined)
        own, third = languages(lang)[owner], np.full(len(i), none)
        on = deep[_passes(table, bits, triple)]
        third[on] = words.code[i[on] + 2]
        kept = _passes(table, bits, pair)
        i, pair, third = i[kept], pair[kept], third[kept]
        if not len(i):
            continue
        used = np.zeros(len(own), bool)
        used[i] = used[i + 1] = True
        used[i[third != 0] + 2] = True
        lexicon.add(texts.buf, words.start[used], words.end[used], words.code[used])
        is_hot = np.isin(pair, hot)
        if is_hot.any():  # a hot pair is counted in a part of its own, and its triples in others
            held.add(own[i[is_hot]], words.code[i[is_hot]], words.code[i[is_hot] + 1], np.full(is_hot.sum(), none), np.zeros(is_hot.sum(), np.int64), np.ones(is_hot.sum(), np.int64))
            kept = ~is_hot | (third != 0)
            i, third, is_hot = i[kept], third[kept], is_hot[kept]
        part = np.where(is_hot, 1 + (mix64(third) % np.uint64(HOT_PARTS)).astype(np.int64), 0)
        held.add(own[i], words.code[i], words.code[i + 1], third, part, np.ones(len(i), np.int64))
        if held.full():
            yield from flush()
    if held.rows:
        yield from flush()


def equal_parts(keys: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey three-way quicksort of rows of keys (-1: the row ends there); depth, a row and weight of each equal part.

    keys has a row for each depth. All parts of one round are split at once, each about the median of its first, middle
    and last pointer. Parts that weigh less than `least` are abandoned; an equal part is sorted on by the next key.
    """
    depth_of, row_of, size_of = [], [], []
    flat, pointer = keys.ravel(), np.flatnonzero(keys[0] >= 0)
    starts, depth = np.zeros(min(len(pointer), 1), np.int64), np.zeros(min(len(pointer), 1), np.int64)
    while len(pointer):
        sizes = np.diff(np.append(starts, len(pointer)))
        own = np.repeat(np.arange(len(starts)), sizes)
        key = flat.take(depth[own] * keys.shape[1] + pointer)
        picks = np.stack([key[starts], key[starts + sizes // 2], key[starts + sizes - 1]])
        pivot = np.sort(picks, axis=0)[1][own]
        side = np.where(key < pivot, 0, np.where(key == pivot, 1, 2))
        # a stable deal into the three sides of every part
        part = 3 * own + side
        counts = np.bincount(part, minlength=3 * len(starts))
        begins = np.cumsum(counts) - counts
        place = np.empty(len(pointer), np.int64)
        for s in range(3):
            mine = np.flatnonzero(side == s)
            p = part[mine]
            ranks = np.arange(len(mine)) - np.repeat(np.cumsum(counts[s::3]) - counts[s::3], counts[s::3])
            place[mine] = begins[p] + ranks
        dealt = np.empty_like(pointer)
        dealt[place] = pointer
        pointer = dealt
        full = np.flatnonzero(counts)
        begins, counts = begins[full], counts[full]
        weight = np.add.reduceat(weights[pointer], begins)
        deep, equal = depth[full // 3], full % 3 == 1
        enough = weight >= least
        out = equal & enough
        depth_of.append(deep[out])
        row_of.append(pointer[begins[out]])
        size_of.append(weight[out])
        deep = deep + equal
        on = enough & (deep < len(keys))
        kept = np.repeat(on, counts)
        pointer, part, deep = pointer[kept], np.repeat(np.arange(on.sum()), counts[on]), deep[on]
        ends = flat.take(deep[part] * keys.shape[1] + pointer) < 0  # rows that end before the next key
        pointer, part = pointer[~ends], part[~ends]
        counts = np.bincount(part, minlength=len(deep))
        depth, counts = deep[counts > 0], counts[counts > 0]
        starts = np.cumsum(counts) - counts
    nothing = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else nothing for x in (depth_of, row_of, size_of))


def _sort_pointers(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Frequent phrases among the pointers of a task; every phrase's pointers are in one task."""
    names = ["lang", "w1", "w2", "w3"]
    coded: dict[str, list[pa.Array]] = {c: [] for c in names}
    parts, weights = [], []
    for batch in batches:
        for c in names:
            coded[c].append(batch.column(c).cast(pa.large_string()).dictionary_encode())
        parts.append(batch.column("part").to_numpy(zero_copy_only=False))
        weights.append(batch.column("n").to_numpy(zero_copy_only=False))
    if not parts:
        return
    columns = {c: pa.chunked_array(x).unify_dictionaries().combine_chunks() for c, x in coded.items()}
    keys = np.stack([columns[c].indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in names])
    hot, weight = np.concatenate(parts) > 0, np.concatenate(weights)
    for mine, shallow in ((~hot, 2), (hot, 3)):  # the parts of a hot pair count its phrases of three words only
        rows = np.flatnonzero(mine)
        depth, row, size = equal_parts(keys[:, rows], weight[rows], least)
        deep = depth >= shallow
        row, size, third = rows[row[deep]], size[deep], depth[deep] == 3
        at = pa.array(row)
        out = [columns[c].dictionary.take(columns[c].indices.take(at)) for c in names[:3]]
        out.append(columns["w3"].dictionary.take(columns["w3"].indices.take(pa.array(row, mask=~third))))
        yield from chunks(pa.RecordBatch.from_arrays([*out, pa.array(size, pa.int64())], [*names, "a"]))


def frequent_phrases(docs: DataFrame, least: int = 10, text_col: str = "text", lang_col: str = "lang", filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent single words (lang, w1, a), phrases of two and three words (lang, w1, w2, w3, a), and words in all (lang, n).

    `least` must be positive. The filter has a bit for each word, 2^filter_bits at most; a fuller one lets more pointers
    pass, which are then counted and abandoned, so results do not depend on it. A null text is empty, a null language `und`; a language without words has no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = written(source.mapInArrow(_count_words, _COUNTED).groupBy("lang", "w1").agg(F.sum("n").alias("a")), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    n_all = totals.agg(F.sum("n")).first()[0] or 0
    bits = min(max(n_all - 1, 1).bit_length(), filter_bits)
    bits = max(bits, PIECE_BITS)
    sketch = source.mapInArrow(lambda it: _sketch(it, bits), _SKETCHED).repartition("piece", "code")
    sketch = written(sketch.mapInArrow(lambda it: _merge_sketches(it, least), "piece int, bits binary, code long, n long"), "sketch")
    table = np.zeros(1 << bits - 3, np.uint8)  # 2^filter_bits bits at most
    for row in sketch.where("piece >= 0").select("piece", "bits").toLocalIterator():
        at = row["piece"] << PIECE_BITS - 3
        table[at : at + (1 << PIECE_BITS - 3)] = np.frombuffer(bytes(row["bits"]), np.uint8)
    # a pair above one in HOT_SHARE is above it in a flush at least; fewer than 4 * HOT_SHARE pairs can have a quarter of that share
    common = sketch.where("piece < 0").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") > n_all // (4 * HOT_SHARE)).select("code").collect()
    hot = np.array(sorted(r["code"] for r in common), np.int64).view(np.uint64)
    pointers = source.mapInArrow(lambda it: _pointers(it, table, bits, hot), _POINTERS)
    routed = pointers.repartition("lang", "w1", "w2", "part")
    phrases = written(routed.mapInArrow(lambda it: _sort_pointers(it, least), "lang string, w1 string, w2 string, w3 string, a long"), "phrases")
    forget(sketch)
    return words.where(F.col("a") >= least), phrases, totals


def _score(left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) without a loss: products are decimals of up to 38 digits."""
    wide = lambda c: f"CAST({c} AS DECIMAL(15,0))"
    return F.expr(f"CAST(({wide('a')} * {wide('a')} * CAST(1000000 AS DECIMAL(7,0))) div ({wide(left)} * {wide(right)}) AS BIGINT)")


def collocations(docs: DataFrame, least: int = 10, swallowed_percent: int = 50, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase counts if it stands `least` times or more inside pieces of text between marks and line ends. Cut in
    two parts with counts l and r, a phrase of count a scores floor(1000000 * a * a / (l * r)); its
    lowest score counts, of equal ones that of the first cut. A phrase goes if a longer frequent one that holds
    it has swallowed_percent of its count or more. The first `most` of each language stay, by score, count and bytes.

    Null and empty texts have no words; a null language is `und`; repeated rows count each; an empty table gives
    no rows; further columns do not matter. Counts are exact; a and l * r must stay below 10^15 and 10^31.
    """
    words, phrases, totals = frequent_phrases(docs, least, text_col, lang_col)
    pairs = phrases.where("w3 IS NULL").select("lang", "w1", "w2", "a")
    triples = phrases.where("w3 IS NOT NULL")
    one = lambda w, n: words.select("lang", F.col("w1").alias(w), F.col("a").alias(n))
    two = lambda v, w, n: pairs.select("lang", F.col("w1").alias(v), F.col("w2").alias(w), F.col("a").alias(n))
    covers = triples.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    covers = covers.groupBy("lang", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.max("a").alias("longer"))
    short = pairs.join(covers, ["lang", "w1", "w2"], "left").where(F.expr(f"longer IS NULL OR 100 * longer < {int(swallowed_percent)} * a"))
    short = short.join(one("w1", "l"), ["lang", "w1"]).join(one("w2", "r"), ["lang", "w2"])
    short = short.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("l", "r").alias("score"))
    long = triples.join(one("w1", "l1"), ["lang", "w1"]).join(two("w2", "w3", "r1"), ["lang", "w2", "w3"]).join(two("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(one("w3", "r2"), ["lang", "w3"])
    cut = F.least(F.struct(_score("l1", "r1").alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r1").alias("r")), F.struct(_score("l2", "r2").alias("score"), F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("r2").alias("r")))
    long = long.withColumn("cut", cut).select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    best = short.unionByName(long).withColumn("rank", rank).where(F.col("rank") <= most)
    return best.join(F.broadcast(totals) if totals.limit(10_001).count() <= 10_000 else totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
