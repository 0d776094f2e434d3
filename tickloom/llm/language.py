"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. The vector of three letters in a row binds (multiplies)
the letters' vectors, permuted (rotated) by their places. A text bundles (sums) the vectors of all its
triples; a language's prototype bundles its texts. A text gets the language of the nearest prototype
by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tables import bounded_batches
from tickloom.llm.textcodes import Texts, mix64, slices

DIMENSIONS, SEED = 1024, 5
#: Bytes and rows that one table of counts (texts by triples) holds.
SLICE = (384 << 10, 192)
#: Distinct triples whose vectors are multiplied at a time.
TILE = 4096
UNKNOWN = "und"
#: Labels that may be learned: each costs the driver a prototype.
MOST_LANGUAGES = 1000
_letters: dict[str, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, 0 for everything else."""
    if "table" not in _letters:
        table = np.zeros(0x10000, np.uint32)
        for c in range(0x10000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
        _letters["table"] = table
    return _letters["table"]


def _letter_vectors(points: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Rows of +1 and -1, a function of the code point alone; 0, the gap between words, has one too."""
    lanes = np.arange(-(-dimensions // 64), dtype=np.uint64)
    bits = mix64(mix64(points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[:, None] + lanes + np.uint64(1))
    bits = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1)[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


class _Encoder:
    """Triples of letters of a slice of texts; vectors of triples are kept between slices."""

    LIMIT = 12288

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.known = np.zeros(0, np.uint64)
        self.vectors = np.zeros((0, dimensions), np.int8)

    def triples(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Text and packed letters of each triple whose middle is a letter."""
        heads = (texts.buf & 0xC0) != 0x80
        offsets = np.concatenate(([0], np.cumsum(heads)))[texts.offsets]
        raw = texts.buf.tobytes()
        points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        if len(points) != offsets[-1]:  # bytes that are not UTF-8
            each = [np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)]
            points, offsets = np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))
        table = _letter_table()
        high = points > 0xFFFF
        letters = table[np.where(high, 0, points)]
        if high.any():
            wide = np.unique(points[high])
            alpha = np.array([chr(c).isalpha() for c in wide])
            letters = np.where(high & np.isin(points, wide[alpha]), points, letters)
        # a gap around every text; runs of other characters shrink to one gap
        at = np.arange(len(points)) + np.repeat(np.arange(len(texts)) + 1, np.diff(offsets))
        line = np.zeros(len(points) + len(texts) + 1, np.uint64)
        line[at] = letters
        owner = np.full(len(line), -1, np.int64)
        owner[at] = np.repeat(np.arange(len(texts)), np.diff(offsets))
        keep = np.ones(len(line), bool)
        keep[1:] = (line[1:] != 0) | (line[:-1] != 0)
        line, owner = line[keep], owner[keep]
        if len(line) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        middle = line[1:-1] != 0
        packed = line[:-2] << np.uint64(42) | line[1:-1] << np.uint64(21) | line[2:]
        return owner[1:-1][middle], packed[middle]

    def sums(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The bundle of every text, and how many triples it has. Texts meet TILE distinct triples at a time."""
        owner, packed = self.triples(texts)
        own, inverse = np.unique(packed, return_inverse=True)
        out = np.zeros((len(texts), self.dimensions))
        order = np.argsort(inverse, kind="stable") if len(own) > TILE else slice(None)
        inverse, rows = inverse[order], owner[order]
        for lo in range(0, len(own), TILE):
            wide = min(TILE, len(own) - lo)
            part = slice(*np.searchsorted(inverse, (lo, lo + wide))) if len(own) > TILE else slice(None)
            table = np.bincount(rows[part] * wide + inverse[part] - lo, minlength=len(texts) * wide).reshape(len(texts), wide)
            out += table.astype(np.float32) @ self.of(own[lo : lo + wide]).astype(np.float32)
        return out, np.bincount(owner, minlength=len(texts))

    def of(self, packed: np.ndarray) -> np.ndarray:
        """Vectors of at most TILE distinct triples, in order."""
        new = packed[~np.isin(packed, self.known)]
        if len(self.known) + len(new) > self.LIMIT:
            self.known, self.vectors = np.zeros(0, np.uint64), np.zeros((0, self.dimensions), np.int8)
            new = packed
        if len(new):
            mask = np.uint64((1 << 21) - 1)
            vectors = None
            for place, shift in ((2, 42), (1, 21), (0, 0)):
                points = new >> np.uint64(shift) & mask
                letters, back = np.unique(points, return_inverse=True)
                own = np.roll(_letter_vectors(letters, self.dimensions, self.seed), place, axis=1)[back]
                vectors = own if vectors is None else np.multiply(vectors, own, out=vectors)
            known = np.concatenate((self.known, new))
            order = np.argsort(known)
            self.known, self.vectors = known[order], np.concatenate((self.vectors, vectors))[order]
        return self.vectors[np.searchsorted(self.known, packed)]


def _bundle(batches: Iterator[pa.RecordBatch], dimensions: int, seed: int) -> Iterator[pa.RecordBatch]:
    encoder, sums = _Encoder(dimensions, seed), {}
    for batch in batches:
        for part in slices(batch, "text", *SLICE):
            own, _ = encoder.sums(Texts(part.column("text")))
            names = np.array(part.column("lang").to_pylist(), object)
            for name in set(names):
                sums[name] = sums.get(name, 0) + np.rint(own[names == name].sum(0)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "bundle"])


def language_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, list[int]]:
    """Bundle of every language of the labelled rows; all rows count.

    The driver gets dimensions * languages numbers; more than MOST_LANGUAGES labels are an error. An empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    parts = labelled.mapInArrow(lambda it: _bundle(it, dimensions, seed), "lang string, bundle array<long>")
    rows = parts.select("lang", F.posexplode("bundle").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    out: dict[str, list[int]] = {}
    found = rows.limit(MOST_LANGUAGES * dimensions + 1).collect()
    if len(found) > MOST_LANGUAGES * dimensions:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    for r in found:
        out.setdefault(r["lang"], [0] * dimensions)[r["d"]] = r["x"]
    return dict(sorted(out.items()))


def _nearest(batches: Iterator[pa.RecordBatch], text: str, names: list[str], prototypes: np.ndarray, dimensions: int, seed: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    encoder = _Encoder(dimensions, seed)
    for batch in batches:
        for part in slices(batch, text, *SLICE):
            own, count = encoder.sums(Texts(part.column(text)))
            seen = (count > 0) & bool(len(names))
            cosine = (own @ prototypes.T) / np.maximum(np.linalg.norm(own, axis=1), 1e-9)[:, None] if len(names) else np.zeros((len(own), 1))
            best, score = np.where(seen, cosine.argmax(1), -1), np.where(seen, np.clip(cosine.max(1), 0, 1), 0)
            label = [names[b] if b >= 0 else UNKNOWN for b in best]
            others = [c for c in part.schema.names if keep_text or c != text]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(label, pa.string()), pa.array(score, pa.float64())], [*others, "lang_pred", "score"])


def held_out(id_col: str | Column = "doc_id", parts: int = 5) -> Column:
    """Whether a row is kept from training: crc32 of its id as text is divisible by `parts`; never for a null id."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % parts == 0, F.lit(False))


def with_language(docs: DataFrame, prototypes: dict[str, list[int]], text_col: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED, keep_text: bool = True) -> DataFrame:
    """docs with the columns lang_pred and score, which replace columns of those names.

    The language is that of the nearest prototype by cosine; score is that cosine, at least 0. lang_pred
    is `und` and the score 0 if the text is null, empty or has no letter, or if there is no prototype.
    Ties go to the language first by name. Repeated rows give a row each; texts are taken whole.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float64).reshape(len(names), dimensions)
    matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    bounded_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    own = docs.select(*(F.col(f"`{c}`").cast("string").alias(f"c{i}") if c == text_col else F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    text = f"c{columns.index(text_col)}"
    kept = [(f"c{i}", c) for i, c in enumerate(columns) if keep_text or c != text_col]
    schema = ", ".join([*(f"{c} {own.schema[c].dataType.simpleString()}" for c, _ in kept), "lang_pred string", "score double"])
    out = own.mapInArrow(lambda it: _nearest(it, text, names, matrix, dimensions, seed, keep_text), schema)
    return out.toDF(*(c for _, c in kept), "lang_pred", "score")


def identify_language(docs: DataFrame, prototypes: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Language of every text: id_col, held_out, lang_pred and score, as with_language has them."""
    own = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return with_language(own, prototypes, "_text", dimensions, seed, keep_text=False)
