"""Running statistics per symbol and stream; long keys are split into chunks of time, as in tickloom.operators.asof."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import bps_move, event_order, log_basis_bps, mid
from tickloom.functions.scratch import kept
from tickloom.operators.asof import DAY_MS, Timeline, merged, running_last, running_two

#: Rows of one key that a block of a rows-frame holds.
BLOCK_ROWS = 4096


def previous_quote(quotes: DataFrame) -> DataFrame:
    """quotes with mid and previous_mid, that of the stream's preceding tick."""
    own = quotes.withColumn("mid", mid())
    return running_last(own, ["symbol", "venue"], "local_ts_ms", event_order(), {"previous_mid": F.col("mid")}, current=False)


def midpoint_returns(quotes: DataFrame) -> DataFrame:
    """row_no, symbol, venue, ts and ret (bps) between neighbouring mids of a stream; mids of 0 or less leave first."""
    own = quotes.withColumn("mid", mid()).where("mid > 0").withColumn("ts", F.col("local_ts_ms"))
    own = running_last(own, ["symbol", "venue"], "ts", [F.col("ts"), F.col("row_no")], {"before": F.col("mid")}, current=False)
    return own.where("before > 0").select("row_no", "symbol", "venue", "ts", bps_move(F.col("mid"), F.col("before")).alias("ret"))


def feed_gaps(quotes: DataFrame, stale_ms: int | None = None) -> DataFrame:
    """quotes with gap_ms to the stream's previous tick (0 for the first and for backward clocks) and stale."""
    own = running_last(quotes, ["venue", "symbol"], "local_ts_ms", event_order(), {"before": F.col("local_ts_ms")}, current=False)
    gap = F.coalesce(F.greatest(F.lit(0), F.col("local_ts_ms") - F.col("before")), F.lit(0))
    stale = gap > stale_ms if stale_ms is not None else F.lit(False)
    return own.withColumn("gap_ms", gap.cast("long")).withColumn("stale", stale).drop("before")


def with_position(df: DataFrame, keys: list[str], ts: str, order: list[Column], name: str = "position", chunk_ms: int | None = DAY_MS) -> DataFrame:
    """df with each row's place (from 0) in its key's order: row numbers by chunk plus the counts of earlier chunks."""
    if chunk_ms is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    df = df.withColumn("_chunk", F.floor(F.col(ts) / chunk_ms))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    counts = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order)))
    return own.join(counts, [*keys, "_chunk"]).withColumn(name, F.col("_base") + F.col("_rank") - 1).drop("_chunk", "_base", "_rank")


def running_sums(df: DataFrame, keys: list[str], ts: str, order: list[Column], sums: dict[str, Column], chunk_ms: int | None = DAY_MS) -> DataFrame:
    """df with running sums, the current row included; chunks of time run apart and get the totals of those before.

    The totals of a key, a row for each chunk of its history, are one window; rows are never in one window but by chunk.
    """
    if chunk_ms is None:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(*(c for c in df.columns if c not in sums), *(F.coalesce(F.sum(v).over(frame), F.lit(0)).alias(n) for n, v in sums.items()))
    df = df.withColumn("_chunk", F.floor(F.col(ts) / chunk_ms))
    totals = df.groupBy(*keys, "_chunk").agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in sums.items()))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_chunk", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_in_{n}") for n in sums))
    own = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = df.select("*", *(F.sum(v).over(own).alias(f"_own_{n}") for n, v in sums.items())).join(carried, [*keys, "_chunk"])
    return inner.select(*(c for c in df.columns if c not in (*sums, "_chunk")), *((F.coalesce(f"_own_{n}", F.lit(0)) + F.col(f"_in_{n}")).alias(n) for n in sums))


def pair_frame(quotes: DataFrame, leader: str, lagger: str, columns: list[str], timelines: dict[str, Timeline] | None = None) -> DataFrame:
    """Each tick of either venue with the latest quote of both (structs leader, lagger: this tick included), the quotes before those
    (leader_before, lagger_before), the latest value of each timeline at its time, and position: the number of earlier ticks at which
    both were known, -1 before. Everything comes out of one sort of a union.
    """
    own = quotes.where(F.col("venue").isin(leader, lagger))
    timelines = timelines or {}
    both, order, values = merged(own, timelines, ["symbol"], "local_ts_ms", event_order())
    quote = F.struct(*columns)
    of = lambda v: F.when((F.col("_side") == 1) & (F.col("venue") == v), quote)
    out = running_two(both, ["symbol"], "_t", order, {"leader": of(leader), "lagger": of(lagger)}, values, counted=F.col("_side") == 1)
    return out.where("_side = 1").select(*own.columns, "leader", "leader_before", "lagger", "lagger_before", "position", *timelines)


def basis_samples(quotes: DataFrame, leader: str = "binance", lagger: str = "mexc", beta: float = 1.0) -> DataFrame:
    """A basis sample for each tick of either venue once both are known: ts is the later of their two clocks.

    Columns: row_no, symbol, venue, local_ts_ms, exchange_ts_ms, ts, basis, leader, lagger, leader_before and position, the
    number of earlier samples.
    """
    pairs = pair_frame(quotes.withColumn("mid", mid()), leader, lagger, ["local_ts_ms", "mid", "bid", "ask", "row_no"])
    return with_basis(pairs, beta).where("position >= 0").drop("lagger_before", "mid")


def with_basis(pairs: DataFrame, beta: float = 1.0) -> DataFrame:
    """pairs with ts, the later of the two clocks, and basis; null before both venues are known."""
    known = F.col("position") >= 0
    return pairs.withColumn("ts", F.when(known, F.greatest("leader.local_ts_ms", "lagger.local_ts_ms"))).withColumn("basis", F.when(known, log_basis_bps(F.col("leader.mid"), F.col("lagger.mid"), beta)))


def rolling_basis_mean(samples: DataFrame, n: int = 120, block: int = BLOCK_ROWS) -> DataFrame:
    """samples with rolling_mean, that of the n samples before, and rolling_count.

    Blocks of positions get the last n rows of the block before as well, so each is a window of its own.
    """
    block = max(block, n)
    home = F.floor(F.col("position") / block)
    spread = F.when(F.col("position") % block >= block - n, F.array(home, home + 1)).otherwise(F.array(home))
    own = samples.withColumn("_home", home).withColumn("_block", F.explode(spread))
    frame = Window.partitionBy("symbol", "_block").orderBy("position").rowsBetween(-n, -1)
    own = own.withColumn("rolling_mean", F.avg("basis").over(frame)).withColumn("rolling_count", F.count("basis").over(frame))
    return own.where("_home = _block").drop("_home", "_block")


def ewm_basis(samples: DataFrame, window_ms: int = 180_000, chunk_ms: int = DAY_MS) -> DataFrame:
    """samples with ewm_mean and ewm_var after each sample and prior_mean and prior_var before it.

    samples: symbol, ts, position and basis; rows without a basis, which may come before the first, have no moments.
    The weight of a sample is 1 - exp(-dt / window); one at an unchanged time does not count. The mean of x and that of
    x^2 are the same affine map of what was before, a factor that depends on time alone and an offset. The variance is their
    difference. Each chunk is composed into one such map by an aggregate, the maps are composed in order over the
    chunks of a symbol, and rows are prefix sums of their chunk, scaled so that exponents stay below 300 windows.
    """
    w = F.lit(float(window_ms))
    chunk_ms = max(1, min(chunk_ms, 300 * window_ms))
    own = samples.withColumn("_chunk", F.floor(F.col("ts") / chunk_ms))
    start = F.col("_chunk") * chunk_ms
    chunk = Window.partitionBy("symbol", "_chunk").orderBy("ts", "position")
    sampled = F.col("basis").isNotNull()
    own = own.withColumn("_at", (F.col("ts") - start) / w).withColumn("_last", F.last(F.when(sampled, F.col("ts")), True).over(chunk.rowsBetween(Window.unboundedPreceding, -1)))
    # offsets of all samples but a chunk's first, whose weight depends on the chunk before
    weight = (1 - F.exp(-(F.col("ts") - F.col("_last")) / w)) * F.exp("_at")
    own = own.withColumn("_x", F.coalesce(weight * F.col("basis"), F.lit(0.0))).withColumn("_xx", F.coalesce(weight * F.col("basis") * F.col("basis"), F.lit(0.0)))
    first = F.min_by(F.struct("ts", "basis", "_at"), F.when(sampled, F.struct("ts", "position")))
    maps = own.groupBy("symbol", "_chunk").agg(first.alias("_first"), F.max(F.when(sampled, F.col("ts"))).alias("_end"), F.sum("_x").alias("_sum_x"), F.sum("_xx").alias("_sum_xx"))
    earlier = Window.partitionBy("symbol").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    maps = maps.withColumn("_until", F.last("_end", True).over(earlier))
    alpha = F.when(F.col("_until").isNull(), 1.0).otherwise(1 - F.exp(-(F.col("_first.ts") - F.col("_until")) / w))
    lift = alpha * F.exp("_first._at")
    maps = maps.withColumn("_first_x", F.coalesce(lift * F.col("_first.basis"), F.lit(0.0))).withColumn("_first_xx", F.coalesce(lift * F.col("_first.basis") * F.col("_first.basis"), F.lit(0.0)))
    maps = _composed(maps, {"_in_x": F.col("_sum_x") + F.col("_first_x"), "_in_xx": F.col("_sum_xx") + F.col("_first_xx")}, window_ms, chunk_ms)
    # the state at the end of the chunk before, undecayed
    for n in ("x", "xx"):
        maps = maps.withColumn(f"_end_{n}", F.last((F.col(f"_in_{n}") + F.col(f"_sum_{n}") + F.col(f"_first_{n}")) * F.exp((start - F.col("_end")) / w), True).over(earlier))
    out = own.join(maps.select("symbol", "_chunk", "_in_x", "_in_xx", "_first_x", "_first_xx", "_end_x", "_end_xx"), ["symbol", "_chunk"])
    until = chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n in ("x", "xx"):
        out = out.withColumn(f"_now_{n}", F.when(sampled, F.exp(-F.col("_at")) * (F.col(f"_in_{n}") + F.col(f"_first_{n}") + F.sum(f"_{n}").over(until))))
    for n in ("x", "xx"):
        out = out.withColumn(f"_old_{n}", F.when(F.col("_last").isNull(), F.col(f"_end_{n}")).otherwise(F.lag(f"_now_{n}").over(chunk)))
    spread = lambda x, xx: F.greatest(F.col(xx) - F.col(x) * F.col(x), F.lit(0.0))
    return out.select(*samples.columns, F.col("_now_x").alias("ewm_mean"), spread("_now_x", "_now_xx").alias("ewm_var"), F.col("_old_x").alias("prior_mean"), F.when(F.col("_old_x").isNotNull(), spread("_old_x", "_old_xx")).alias("prior_var"))


def _composed(maps: DataFrame, offsets: dict[str, Column], window_ms: int, chunk_ms: int) -> DataFrame:
    """maps, a row for each chunk of a symbol, with what all earlier chunks amount to at its start.

    An offset, given at the scale of its chunk's start, decays with time. Sums run in blocks of 300 windows, each with the block
    before it as well; what is older weighs less than e^-300. Only the rows of chunks are doubled for that, not the samples.
    """
    block_ms = -(-300 * window_ms // chunk_ms) * chunk_ms
    home = F.floor(F.col("_chunk") * chunk_ms / block_ms)
    spread = maps.select("*", *(v.alias(n) for n, v in offsets.items()), home.alias("_home"), F.explode(F.array(home, home + 1)).alias("_block"))
    g = (F.col("_chunk") * chunk_ms - (F.col("_block") - 1) * block_ms) / F.lit(float(window_ms))
    before = Window.partitionBy("symbol", "_block").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.select(*maps.columns, "_home", "_block", *((F.exp(-g) * F.coalesce(F.sum(F.col(n) * F.exp(g)).over(before), F.lit(0.0))).alias(n) for n in offsets))
    return sums.where("_home = _block").drop("_home", "_block")


def cooldown_thin(candidates: DataFrame, cooldown_ms: int, keys: list[str] | None = None, stride: int = 64, fold_rows: int = 1 << 16) -> DataFrame:
    """Greedy thinning: a candidate stays if cooldown_ms (positive) have passed since the last one that stayed, by key.

    Of candidates at one time the first by row_no counts. After a candidate the next that stays is the first one a cooldown later; these
    links are followed at growing strides. Time is cut into chunks of `stride` cooldowns. A chain can enter a chunk only at its
    times within the first cooldown or at the first time after that, so a chunk shrinks to these entries, each linked to where the chain
    that enters there is free again beyond the chunk. Entries shrink in the same way, in chunks `stride` times longer, until no
    key has more than fold_rows of them. These are followed one by one, and what they visit is handed down level by level.
    Each level is about `stride` times smaller than the one before, so a key of any density costs a few shuffles of its times alone;
    a task holds the distinct times of one chunk. The candidates are written once, since they are read several times.
    """
    keys = keys or ["symbol", "model"]
    own, cool = kept(candidates, "candidates"), int(cooldown_ms)
    types = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keys) + ", entry long, free long, row_no long"
    rows = own.select(*keys, F.col("ts").cast("long").alias("entry"), (F.col("ts").cast("long") + cool).alias("free"), F.col("row_no").cast("long").alias("row_no"))
    levels, span, columns = [], cool * stride, [*keys, "entry", "free", "row_no"]
    while (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > fold_rows:
        rows = rows.withColumn("chunk", F.floor(F.col("entry") / span))
        levels.append(rows)
        rows = kept(rows.groupBy(*keys, "chunk").applyInPandas(_shrinking(columns, span, cool), types), "entries")
        span *= stride
    found = rows.groupBy(*keys).applyInPandas(lambda g: _follow(g)[columns], types)
    for rows in reversed(levels):
        span //= stride
        entered = found.select(*keys, "entry", F.floor(F.col("entry") / span).alias("chunk"))
        found = rows.groupBy(*keys, "chunk").cogroup(entered.groupBy(*keys, "chunk")).applyInPandas(lambda g, e: _follow(g, e)[columns], types)
    found = found.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("entry").alias("_ts"), F.col("row_no").alias("_row_no"))
    same = (F.col("ts").cast("long") == F.col("_ts")) & (F.col("row_no") == F.col("_row_no"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return own.join(found, same, "left_semi")


def _links(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The group's distinct times, each with its first row, and for each the place of the first one at or after it is free."""
    group = group.sort_values(["entry", "row_no"]).drop_duplicates("entry")
    return group, np.searchsorted(group["entry"].to_numpy(), group["free"].to_numpy())


def _entries(group: pd.DataFrame, span: int, cooldown: int) -> pd.DataFrame:
    """The entries of a chunk, free where their chains leave it."""
    group, following = _links(group)
    last = np.where(following < len(group), following, np.arange(len(group)))
    while (last[last] != last).any():  # jumps double until every chain is at its end
        last = last[last]
    entry = group["entry"].to_numpy()
    late = np.searchsorted(entry, int(entry[0]) // span * span + cooldown)
    return group.assign(free=group["free"].to_numpy()[last]).iloc[: late + 1]


def _shrinking(columns: list[str], span: int, cooldown: int):
    return lambda group: _entries(group, span, cooldown)[columns]


def _follow(group: pd.DataFrame, entered: pd.DataFrame | None = None) -> pd.DataFrame:
    """The times that a chain stays at, from the entry of the chunk, or from the first time; nothing if it does not enter."""
    group, following = _links(group)
    at = 0 if entered is None else int(np.searchsorted(group["entry"].to_numpy(), entered["entry"].min())) if len(entered) else len(group)
    stays, following = [], following.tolist()
    while at < len(following):
        stays.append(at)
        at = following[at]
    return group.iloc[stays]


def rolling_tail(rows: DataFrame, n: int = 2000, keys: list[str] | None = None) -> DataFrame:
    """The last n rows of each key, by time and arrival; what cannot be among them leaves before the ranking."""
    keys = keys or ["symbol"]
    order = F.struct("ts", "row_no")
    counts = rows.withColumn("_chunk", F.floor(F.col("ts") / DAY_MS)).groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    later = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    need = counts.withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0))).where(F.col("_later") < n).groupBy(*keys).agg(F.min("_chunk").alias("_from"))
    own = rows.join(need, keys).where(F.floor(F.col("ts") / DAY_MS) >= F.col("_from")).drop("_from")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))
    return own.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
