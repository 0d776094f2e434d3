"""Near-duplicate detection by MinHash with tensored banding.

Two small collections of half keys are computed for each distinct shingle set. A table key is a pair
of one half key from each collection, so halves * halves tables need only 2 * halves * rows minhashes.
Halves that no other document has cannot meet in any table, so only shared halves are combined.

Within a table bucket each member is compared with one member (a star), never with all; the member
first in one random order is taken, so the buckets of a large group mostly share their centre. Buckets
that still hold several components have their documents compared again, by one half key at a time (a
wider net than a table key): those outside a half key's largest component are looked up, in blocks of
bounded size, in an inverted index of all the others. A block returns one link for each document and
component that it meets, so no link between components is lost and no pairs are listed. Every link is
confirmed on the full shingle sets.

With 12 halves of 2 rows on each side, a pair of Jaccard similarity 0.75 misses all 144 tables with
probability 1e-4; at 0.8 it is 1e-5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import connected_components
from tickloom.llm.tables import forget, only_ids, without_ids, written
from tickloom.llm.textcodes import SPACED, Texts, mix64, slices

WORDS, HALVES, ROWS, SEED = 5, 12, 2, 11
#: Stand-ins of null ids begin here.
NULL_IDS = 1 << 62
#: Shingles of the documents that a block looks up, and of those that it looks them up in: 8 and 4 MB.
QUERIES, TARGETS = 1 << 20, 1 << 19


def shingle_sets(texts: Texts, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle codes of each text; a text of fewer words has one shingle, an empty one none."""
    found = texts.words(SPACED)
    at, code = found.runs(words)
    cut = np.searchsorted(at, found.bounds)
    out = []
    for i in range(len(texts)):
        if cut[i + 1] > cut[i]:
            out.append(np.unique(code[cut[i] : cut[i + 1]]))
            continue
        own = found.code[found.bounds[i] : found.bounds[i + 1]]
        value = np.uint64(len(own))
        for x in own:
            value = mix64(np.array([value ^ x], np.uint64))[0]
        out.append(np.array([value] if len(own) else [], np.uint64))
    return out


def _half_keys(codes: np.ndarray, halves: int, rows: int, seed: int) -> np.ndarray:
    """2 * halves keys of a shingle set, each from `rows` minhashes and bound to its place."""
    factors = np.random.default_rng(seed).integers(1, 1 << 63, 2 * halves * rows, dtype=np.uint64) | np.uint64(1)
    least = np.full(len(factors), ~np.uint64(0))
    for lo in range(0, len(codes), 4096):
        value = codes[lo : lo + 4096, None] * factors
        value ^= value >> np.uint64(32)
        np.minimum(least, value.min(0), out=least)
    key = np.arange(2 * halves, dtype=np.uint64)
    for r in range(rows):
        key = mix64(key ^ least[r::rows])
    return key


def _sketch(batches: Iterator[pa.RecordBatch], words: int, halves: int, rows: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(Texts(part.column("text")), words)
            keys = [_half_keys(s, halves, rows, seed) if len(s) else np.zeros(0, np.uint64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_id"),
                    part.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([s.sum() for s in sets], np.uint64).view(np.int64)),
                    pa.array(np.array([mix64(s).sum() if len(s) else 0 for s in sets], np.uint64).view(np.int64)),
                    pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64())),
                ],
                ["_id", "id", "n", "s1", "s2", "halves"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(Texts(part.column("text")), words)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "codes"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("codes_a"), batch.column("codes_b")
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, words: int = WORDS, halves: int = HALVES, rows: int = ROWS, seed: int = SEED
) -> DataFrame:
    """Components of documents whose sets of word shingles are similar.

    docs: any table with an integer id and a text column; other columns are not looked at.
    percent: two documents are linked if 100 * intersection >= percent * union of their sets.
    Returns id_col, n_shingles, component_id (smallest id reachable) and kept (id is that smallest one).

    A null or empty text, or one without words, has an empty set and is linked with nothing. Rows that
    share an id are one document and are linked with what any of them is linked with. Rows with a null id
    and one text are one document too: its component is the smallest id reachable and it is not kept, or
    null where only null ids are, and then the one first by a hash of its text is kept. An empty table
    gives an empty result. Long texts are taken whole.
    """
    found = _components(docs.select(F.col(id_col).cast("long").alias("_id"), _key(id_col, text_col).alias("id"), F.col(text_col).cast("string").alias("text")), percent, words, halves, rows, seed)
    named = lambda c: F.when((F.col("_id").isNotNull()) | (F.col(c) < NULL_IDS), F.col(c))
    return found.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), named("component").alias("component_id"), (F.col("component") == F.col("id")).alias("kept"))


def _key(id_col: str, text_col: str) -> Column:
    """The id, or where it is null a stand-in by text that comes after all ids below NULL_IDS."""
    stand_in = F.lit(NULL_IDS) + F.shiftrightunsigned(F.xxhash64(F.col(text_col).cast("string")), 2)
    return F.coalesce(F.col(id_col).cast("long"), stand_in)


def _components(source: DataFrame, percent: int, words: int, halves: int, rows: int, seed: int) -> DataFrame:
    """(_id, id, n, component) of each row of source (_id, id, text); component is the smallest id reachable."""
    kinds = "_id long, id long, n long, s1 long, s2 long, halves array<long>"
    sketch = written(source.mapInArrow(lambda it: _sketch(it, words, halves, rows, seed), kinds), "sketch")
    named = sketch.where("n > 0")
    repeated = not named.groupBy("id").count().where("count > 1").isEmpty()

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        found = only_ids(source, ids, "id").mapInArrow(lambda it: _full_sets(it, words), "id long, codes binary")
        return written(found.distinct() if repeated else found, name)

    # equal sets are one node, their smallest id
    classes = written(named.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.min_by("halves", "id").alias("halves")), "classes")

    keys = _table_keys(classes, halves)
    hub = keys.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    hub = written(hub.select("key", F.col("hub.rep").alias("hub")), "hubs")
    star = keys.join(hub, "key").where("hub <> rep").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))
    links = _linked(star, classes, sets_of, percent)
    labels = connected_components(links)

    # what the stars left apart: documents of buckets that hold several components
    marked = keys.join(hub.select("key"), "key", "left_semi").join(labels, keys["rep"] == labels["id"], "left")
    marked = written(marked.select("key", "rep", F.coalesce("label", "rep").alias("part")), "marked")
    mixed = written(marked.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key"), "mixed")
    apart = written(marked.join(mixed, "key", "left_semi").select("rep", "part").distinct(), "apart")
    forget(keys, hub, marked, mixed, labels)
    more = _linked_apart(apart, classes, sets_of, percent, halves)
    labels = connected_components(links.unionByName(more))
    by_class = classes.join(labels, classes["rep"] == labels["id"], "left").select("n", "s1", "s2", F.coalesce("label", "rep").alias("component"))
    by_class = written(by_class, "by_class")
    forget(classes, apart, links, more, labels)
    whole = sketch.join(by_class, ["n", "s1", "s2"], "left")
    return whole.select("_id", "id", "n", F.coalesce("component", "id").alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """docs with one document of each component, that with the smallest id; all columns stay. Null ids as in near_duplicates."""
    source = docs.select(F.col(id_col).cast("long").alias("_id"), _key(id_col, text_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    gone = _components(source, percent, WORDS, HALVES, ROWS, SEED).where("component <> id").select("id")
    return without_ids(docs, written(gone.distinct(), "near_copies"), _key(id_col, text_col))


def _table_keys(classes: DataFrame, halves: int) -> DataFrame:
    """(key, rep) for every pair of shared half keys, one from each collection."""
    each = written(classes.select("rep", F.posexplode("halves").alias("place", "half")), "each_half")
    common = written(each.groupBy("half").count().where("count > 1").select("half"), "halves")
    shared = each.join(common, "half", "left_semi")
    first = F.collect_list(F.when(F.col("place") < halves, F.col("half")))
    second = F.collect_list(F.when(F.col("place") >= halves, F.col("half")))
    per_rep = shared.groupBy("rep").agg(first.alias("first"), second.alias("second")).where("size(first) > 0 AND size(second) > 0")
    pairs = per_rep.select("rep", F.explode("first").alias("x"), "second").select("rep", "x", F.explode("second").alias("y"))
    keys = written(pairs.select(F.xxhash64("x", "y").alias("key"), "rep"), "keys")
    forget(each, common)
    return keys


def _look_up(group: pa.Table, percent: int) -> pa.Table:
    """Links of the queries of a block to its targets, one for each query and component of targets."""
    asks = group.column("asks").combine_chunks()
    targets, queries = group.filter(pa.compute.invert(asks)).combine_chunks(), group.filter(asks).combine_chunks()
    sets = [np.frombuffer(c.as_buffer(), np.uint64) for c in targets.column("codes")]
    reps, parts, sizes = targets.column("rep").to_numpy(), targets.column("part").to_numpy(), np.array([len(x) for x in sets])
    found_a, found_b = [], []
    if sets:
        code, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        for rep, part, raw in zip(queries.column("rep").to_pylist(), queries.column("part").to_pylist(), queries.column("codes"), strict=True):
            own = np.frombuffer(raw.as_buffer(), np.uint64)
            lo, count = (x := np.searchsorted(code, own)), np.searchsorted(code, own, "right") - x
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            common = np.bincount(owner[at], minlength=len(sets))
            alike = np.flatnonzero((100 * common >= percent * (len(own) + sizes - common)) & (parts != part))
            _, first = np.unique(parts[alike], return_index=True)
            found_a += [rep] * len(first)
            found_b += reps[alike[first]].tolist()
    found = [pa.array(f(found_a, found_b).astype(np.int64)) for f in (np.minimum, np.maximum)]
    return pa.Table.from_arrays(found, ["a", "b"])


def _linked_apart(apart: DataFrame, classes: DataFrame, sets_of: Callable[[DataFrame, str], DataFrame], percent: int, halves: int) -> DataFrame:
    """Links across components between documents (rep, part) that share a half key of the first collection."""
    sets = sets_of(apart.select(F.col("rep").alias("id")), "apart_sets")
    own = apart.join(classes.select("rep", "n", F.slice("halves", 1, halves).alias("halves")), "rep")
    own = written(own.select("rep", "part", "n", F.explode("halves").alias("half")), "apart_halves")
    counts = own.groupBy("half", "part").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    nets = counts.groupBy("half").agg(F.sum("n").alias("size"), F.count("*").alias("parts"), F.max_by("part", F.struct("n", "part")).alias("largest"), F.max("n").alias("most")).where("parts > 1")
    nets = nets.select("half", "largest", F.ceil(F.col("size") / TARGETS).alias("target_blocks"), F.ceil((F.col("size") - F.col("most")) / QUERIES).alias("query_blocks"))
    nets = written(nets, "nets")
    block = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["half", "rep", "part", "asks", "target_block", "query_block"]
    in_nets = own.join(nets, "half")
    targets = in_nets.withColumn("asks", F.lit(False)).withColumn("target_block", block("target_blocks", 1)).withColumn("query_block", every("query_blocks"))
    queries = in_nets.where("part <> largest").withColumn("asks", F.lit(True)).withColumn("query_block", block("query_blocks", 2)).withColumn("target_block", every("target_blocks"))
    rows = written(targets.select(*columns).unionByName(queries.select(*columns)), "blocks")
    full = rows.join(sets.select(F.col("id").alias("rep"), "codes"), "rep").select(*columns, "codes")
    found = full.groupBy("half", "target_block", "query_block").applyInArrow(lambda g: _look_up(g, percent), "a long, b long")
    found = written(found.distinct(), "more_links")
    forget(sets, own, nets, rows)
    return found


def _linked(pairs: DataFrame, classes: DataFrame, sets_of: Callable[[DataFrame, str], DataFrame], percent: int) -> DataFrame:
    """Pairs (a, b) that are similar by their full sets."""
    pairs = written(pairs.distinct(), "pairs")
    near = pairs
    for x in "ab":
        near = near.join(classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}")), x)
    size_fits = F.expr(f"100 * least(n_a, n_b) >= {int(percent)} * greatest(n_a, n_b)")
    near = written(near.where(size_fits).select("a", "b"), "near_pairs")
    ids = written(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near_ids")
    sets = sets_of(ids, "sets")
    both = near
    for x in "ab":
        both = both.join(sets.select(F.col("id").alias(x), F.col("codes").alias(f"codes_{x}")), x)
    found = written(both.select("a", "b", "codes_a", "codes_b").mapInArrow(lambda it: _confirm(it, percent), "a long, b long").distinct(), "links")
    forget(pairs, near, ids, sets)
    return found
