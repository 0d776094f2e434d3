"""How far the sources of a language differ in their words: exact shares, ranked by cells of equal counts.

Terms of a group (a language and a source) with the same count in the group and in the language share one
value, so values are computed and ranked by cell: equal values are merged, ranks follow from cumulative
multiplicity, and only cells that reach the report are expanded into terms. Sources are compared in tiles of
terms and sources, in which terms with equal counts in all sources are one cell as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.tables import BROADCAST_IDS, bounded_batches, written
from tickloom.llm.terms import Held, Lexicon, Numbers, runs_of
from tickloom.llm.textcodes import Texts, byte_class, slices

#: Terms are runs of ASCII letters and anything beyond ASCII.
TERM = byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Shares are counted in parts of this.
SCALE = 1_000_000_000
#: Sources of a tile, and term counts that a slice of a language's terms has.
TILE, SLICE_ROWS = 64, 250_000
_COUNTED = "lang string, term string, df long, sources array<string>, counts array<long>"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each language and term of a flush: its documents, and its counts by source."""
    languages, sources, lexicon = Numbers(), Numbers(), Lexicon()
    held = Held(3)  # language, term, source; counts, documents

    def flush() -> Iterator[pa.RecordBatch]:
        lang, code, source, n, df = held.take()
        order = np.lexsort((source, code, lang))
        lang, code, source, n, df = (x[order] for x in (lang, code, source, n, df))
        fresh = np.ones(len(lang), bool)
        fresh[1:] = (lang[1:] != lang[:-1]) | (code[1:] != code[:-1])
        at = np.flatnonzero(fresh)
        names, words, totals = sources.names(source), lexicon.words(code[at]), np.add.reduceat(df, at)
        bounds = np.append(at, len(lang))
        for lo in range(0, len(at), 1 << 14):
            hi = min(lo + (1 << 14), len(at))
            first, last = bounds[lo], bounds[hi]
            cuts = pa.array(bounds[lo : hi + 1] - first, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [languages.names(lang[at[lo:hi]]), words.slice(lo, hi - lo), pa.array(totals[lo:hi]), pa.ListArray.from_arrays(cuts, names.slice(first, last - first).cast(pa.string())), pa.ListArray.from_arrays(cuts, pa.array(n[first:last]))],
                ["lang", "term", "df", "sources", "counts"],
            )
        lexicon.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            texts = Texts(part.column("text"))
            words = texts.words(TERM)
            if not len(words.code):
                continue
            owner = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
            order, at = runs_of(owner, words.code)  # a document's distinct terms
            doc, code = owner[order[at]], words.code[order[at]]
            lang, source = languages(part.column("lang")), sources(part.column("source"))
            held.add(lang[doc], code, source[doc], np.diff(np.append(at, len(order))), np.ones(len(at), np.int64))
            lexicon.add(texts.buf, words.start, words.end, words.code)
            if held.full():
                yield from flush()
    if held.rows:
        yield from flush()


def kept_terms(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """lang, source, term, gc (count in the group), lc (in the language) and head (one row of each term of a language).

    docs has lang, source and text without nulls. A language keeps the terms that at least least_docs of its documents
    hold. All counts of a term meet in one shuffle by language and term, after they were summed in each task.
    """
    parts = docs.select("lang", "source", "text").mapInArrow(_count_terms, _COUNTED).repartition("lang", "term")
    whole = parts.select("lang", "term", F.posexplode("sources").alias("at", "source"), "counts", "df")
    # a term's documents are counted once for each row of a flush, on its first source
    whole = whole.select("lang", "term", "source", F.element_at("counts", F.col("at") + 1).alias("n"), F.when(F.col("at") == 0, F.col("df")).otherwise(0).alias("df"))
    whole = whole.groupBy("lang", "term", "source").agg(F.sum("n").alias("gc"), F.sum("df").alias("df"))
    of_term = Window.partitionBy("lang", "term")
    whole = whole.select("lang", "source", "term", "gc", F.sum("gc").over(of_term).alias("lc"), F.sum("df").over(of_term).alias("docs"), (F.row_number().over(of_term.orderBy("source")) == 1).alias("head"))
    return whole.where(F.col("docs") >= least_docs).drop("docs")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact: the product is a decimal."""
    return F.expr(f"1 + CAST((CAST({count} + 2 AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(10,0))) div CAST({total} + 2 * {terms} AS DECIMAL(20,0)) AS BIGINT)")


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares stay below 2^30, so squares fit 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _small(df: DataFrame) -> DataFrame:
    """df for a broadcast if it is counted to be small; else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def top_terms(kept: DataFrame, groups: DataFrame, most: int = 10) -> DataFrame:
    """The `most` terms of each group whose share is above their language's, by value and then by bytes."""
    key = ["lang", "source"]
    cells = kept.groupBy(*key, "gc", "lc").agg(F.count("*").alias("terms"))
    cells = cells.join(_small(groups.select(*key, "n", "n_lang", "v")), key).withColumn("p", share("gc", "n", "v")).withColumn("q", share("lc", "n_lang", "v"))
    cells = written(cells.where("p > q").select(*key, "gc", "lc", "terms", distance("p", "q").alias("value")), "cells")
    values = cells.groupBy(*key, "value").agg(F.sum("terms").alias("terms"))
    falling = Window.partitionBy(*key).orderBy(F.col("value").desc())
    values = values.withColumn("_at", F.row_number().over(falling)).where(F.col("_at") <= most)  # each value has a term at least
    before = F.coalesce(F.sum("terms").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).where(F.col("before") < most).select(*key, "value", "before")
    chosen = cells.join(values, [*key, "value"]).select(*key, "gc", "lc", "value", "before")
    place = F.row_number().over(Window.partitionBy(*key, "value").orderBy("term"))
    named = kept.select(*key, "gc", "lc", "term").join(chosen, [*key, "gc", "lc"]).withColumn("_place", place).where(F.col("_place") <= most)
    named = named.withColumn("rank", F.col("before") + F.col("_place")).where(F.col("rank") <= most)
    return named.select(*key, F.lit("term").alias("part"), F.col("term").alias("item"), "value", F.col("rank").cast("int").alias("rank"))


def _tile_sums(group: pd.DataFrame) -> pd.DataFrame:
    """Sums of distances of every two sources of a tile pair over a slice of terms; each unordered pair once."""
    base = group[group["term"].isna()]
    rows = group[group["term"].notna()]
    place = np.sort(base["place"].to_numpy())
    level = np.zeros(len(place), np.int64)
    level[np.searchsorted(place, base["place"].to_numpy())] = base["p"].to_numpy()
    term, names = pd.factorize(rows["term"])
    shares = np.repeat(level[None, :], len(names), axis=0)
    shares[term, np.searchsorted(place, rows["place"].to_numpy())] = rows["p"].to_numpy()
    shares, terms = np.unique(shares, axis=0, return_counts=True)  # terms with equal counts everywhere are one cell
    tile = place // TILE
    low, high = (int(group["low"].iloc[0]), int(group["high"].iloc[0])) if len(group) else (0, 0)
    out = []
    for i in np.flatnonzero(tile == low):
        j = np.flatnonzero((tile == high) & (place > place[i]))
        if len(j):
            p, q = shares[:, i : i + 1], shares[:, j]
            value = ((p - q) ** 2 // (p + q) * terms[:, None]).sum(axis=0)
            out.append(pd.DataFrame({"lang": group["lang"].iloc[0], "low_place": place[i], "high_place": place[j], "value": value, "seen": len(names)}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "low_place": [], "high_place": [], "value": [], "seen": []})


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """For each group every other source of its language with the sum of distances over all kept terms, ranked.

    The rows of a tile pair and slice of terms are bounded; a term is sent once for each tile of other sources. Terms
    that no source of a tile pair has are added from their number. Distances are symmetric, so pairs are computed once.
    """
    key = ["lang", "source"]
    n_rows = kept.count()
    n_slices = max(1, -(-n_rows // SLICE_ROWS))
    tiles = groups.groupBy("lang").agg(F.floor(F.max("place") / TILE).alias("last"))
    own = F.floor(F.col("place") / TILE)
    meets = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda t: F.named_struct(F.lit("low"), F.least(t, own), F.lit("high"), F.greatest(t, own))))
    sized = groups.join(_small(tiles), "lang")
    rows = kept.join(_small(sized.select(*key, "place", "n", "v", "last")), key)
    rows = rows.select("lang", "term", "place", share("gc", "n", "v").alias("p"), meets.alias("m"), F.pmod(F.xxhash64("term"), F.lit(n_slices)).alias("slice"))
    none = sized.where("v > 0").select("lang", F.lit(None).cast("string").alias("term"), "place", F.col("zero").alias("p"), meets.alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_slices - 1).cast("long"))).alias("slice"))
    both = rows.unionByName(none).select("lang", "term", "place", "p", "m.low", "m.high", "slice")
    sums = both.groupBy("lang", "low", "high", "slice").applyInPandas(_tile_sums, "lang string, low_place long, high_place long, value long, seen long")
    sums = sums.groupBy("lang", "low_place", "high_place").agg(F.sum("value").alias("sum"), F.sum("seen").alias("seen"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("item_place"), F.col("zero").alias("item_zero"))
    pairs = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    pairs = pairs.withColumn("low_place", F.least("place", "item_place")).withColumn("high_place", F.greatest("place", "item_place"))
    pairs = pairs.join(sums, ["lang", "low_place", "high_place"], "left")
    rest = (F.col("v") - F.coalesce("seen", F.lit(0))) * distance("zero", "item_zero")
    pairs = pairs.withColumn("value", F.when(F.col("v") == 0, F.lit(0)).otherwise(F.coalesce("sum", F.lit(0)) + rest).cast("long"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("value").desc(), "item"))
    return pairs.select(*key, F.lit("pair").alias("part"), "item", "value", rank.cast("int").alias("rank"))


def source_divergence(docs: DataFrame, least_docs: int = 10, most: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Audit of the sources of each language: lang, source, part, item, value, rank.

    Part `pair` ranks the other sources of the language by their distance over all kept terms; part `term` names
    the `most` kept terms whose share in the group exceeds most that in the language. Shares are smoothed and whole numbers.

    Null texts, languages and sources are read as ''. Every group that occurs has its pairs, even without terms; a
    language without kept terms has pairs of value 0. Repeated rows count each; an empty table gives no rows;
    further columns do not matter. Counts must stay below 10^15.
    """
    bounded_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    kept = written(kept_terms(source, least_docs), "kept_terms")
    own = kept.groupBy("lang", "source").agg(F.sum("gc").alias("n"))
    of_lang = kept.where("head").groupBy("lang").agg(F.sum("lc").alias("n_lang"), F.count("*").alias("v"))
    groups = source.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["n", "n_lang", "v"])
    groups = groups.withColumn("place", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"))
    groups = written(groups.withColumn("zero", F.when(F.col("v") > 0, share("0", "n", "v"))), "groups")
    return source_pairs(kept, groups).unionByName(top_terms(kept, groups, most))
