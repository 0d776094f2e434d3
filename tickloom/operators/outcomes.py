"""What becomes of intents: fills under several models, exits by barriers, profit and loss."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.exprs import LAGGER, LEADER, event_order, log_basis_bps, mid, pnl_values
from tickloom.functions.scratch import kept
from tickloom.operators.asof import HOUR_MS, asof_backward, asof_forward, latest_pair
from tickloom.operators.windows import running_sums

MODELS = ("touch", "trade_through", "queue_aware")


def at_quote(intents: DataFrame, quotes: DataFrame) -> DataFrame:
    """intents with `quote`: the latest quote of their symbol on the executing venue."""
    return asof_backward(intents, quotes, ["symbol"], F.struct("row_no", "local_ts_ms", "bid", "ask", "bid_size", "ask_size"), "quote", left_ts="created_ts_ms")


def fill_quote(intents: DataFrame, model: Column | str, queue_ahead: float = 0.0) -> DataFrame:
    """intents (with quote) with filled, fill_price, fill_qty and fill_reason; a missing size counts as 0, and is named in the reason."""
    model = F.lit(model) if isinstance(model, str) else model
    buy = F.col("side") == "buy"
    price = F.when(buy, F.col("quote.ask")).otherwise(F.col("quote.bid"))
    size = F.when(buy, F.col("quote.ask_size")).otherwise(F.col("quote.bid_size"))
    touched = F.when(buy, F.col("quote.ask") <= F.col("price_cap")).otherwise(F.col("quote.bid") >= F.col("price_cap"))
    enough = F.greatest(F.lit(0.0), F.coalesce(size, F.lit(0.0)) - queue_ahead) >= F.col("qty")
    reason = (
        F.when(F.col("quote").isNull(), "no_quote").when(~touched, "price_not_touched").when(model == "touch", "touch").when(model != "queue_aware", "trade_required")
        .when(enough, "queue_available").when(size.isNull(), "queue_size_unknown").otherwise("queue_not_available")
    )
    filled = F.col("fill_reason").isin("touch", "queue_available")
    out = intents.withColumn("fill_model", model).withColumn("fill_reason", reason).withColumn("filled", filled)
    return out.withColumn("fill_price", F.when(F.col("filled"), price)).withColumn("fill_qty", F.when(F.col("filled"), F.col("qty")).otherwise(0.0))


def fill_model_variants(intents: DataFrame) -> DataFrame:
    """The same intents under every model, in one pass."""
    return fill_quote(intents.withColumn("_model", F.explode(F.array(*(F.lit(m) for m in MODELS)))), F.col("_model")).drop("_model")


def fill_model_diagnostics(fills: DataFrame) -> DataFrame:
    """One row an intent: its result under each model, and whether models differ in fill or price."""
    result = F.struct("filled", "fill_price", "fill_qty", "fill_reason")
    differs = (F.count_distinct("filled") > 1) | (F.count_distinct("fill_price") > 1)
    return fills.groupBy("intent_id", "symbol").agg(differs.alias("has_difference"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("fill_model", result)))).alias("models"))


def first_trade_through(intents: DataFrame, trades: DataFrame, ttl_ms: int, chunk_ms: int = HOUR_MS) -> DataFrame:
    """intents with the first later trade, within ttl_ms, at or beyond their cap: fill_price, fill_qty, fill_ts_ms and trade_row.

    Intents meet the trades of their chunk of time (ttl_ms at least) and of the ttl_ms after it, so a trade is dealt out twice
    at most and no intent is paired with the trades of its life. In a task the next price at or beyond a cap is found by
    bisection over running extremes of 1, 2, 4, ... trades. Trades without a price or time, and intents without a cap, match nothing.
    """
    width = max(int(ttl_ms), int(chunk_ms))
    key = intents.schema["intent_id"].dataType.simpleString()
    asks = intents.where("price_cap IS NOT NULL AND created_ts_ms IS NOT NULL").select(F.col("intent_id").cast("string").alias("intent_id"), F.lit(-1).cast("long").alias("row_no"), "symbol", (F.col("side") == "buy").alias("buy"), F.col("price_cap").cast("double").alias("cap"), F.col("created_ts_ms").alias("ts"), F.floor(F.col("created_ts_ms") / width).alias("chunk"))
    chunk = lambda back: F.floor((F.col("local_ts_ms") - back) / width)
    hits = trades.where("price IS NOT NULL AND local_ts_ms IS NOT NULL").select("symbol", "row_no", F.col("local_ts_ms").alias("ts"), F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"), F.explode(F.array_distinct(F.array(chunk(int(ttl_ms)), chunk(1)))).alias("chunk"))
    both = asks.unionByName(hits, allowMissingColumns=True).repartition("symbol", "chunk").sortWithinPartitions("symbol", "chunk")
    found = both.mapInPandas(lambda frames: _through_by_chunk(frames, int(ttl_ms)), "intent_id string, fill_price double, _trade_qty double, fill_ts_ms long, trade_row long")
    found = found.withColumn("intent_id", F.col("intent_id").cast(key))
    out = intents.join(found, "intent_id", "left")
    return out.select(*intents.columns, F.col("trade_row").isNotNull().alias("filled"), "fill_price", F.when(F.col("trade_row").isNotNull(), F.least("qty", "_trade_qty")).alias("fill_qty"), "fill_ts_ms", "trade_row")


def _through_by_chunk(frames: Iterator[pd.DataFrame], ttl_ms: int, rows: int = 100_000) -> Iterator[pd.DataFrame]:
    """Whole chunks together, about `rows` rows at a time; frames come in the order of chunks."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) < rows:
            continue
        whole = pd.concat(held)
        last = ((whole["symbol"] == whole["symbol"].iloc[-1]) & (whole["chunk"] == whole["chunk"].iloc[-1])).to_numpy()
        held = [whole[last]]
        if not last.all():
            yield _first_through(whole[~last], ttl_ms)
    if held:
        yield _first_through(pd.concat(held), ttl_ms)


def _first_through(both: pd.DataFrame, ttl_ms: int) -> pd.DataFrame:
    """For each intent the first trade of its chunk, later and within ttl_ms, at or beyond its cap."""
    both = both.assign(part=both.groupby(["symbol", "chunk"], sort=False, dropna=False).ngroup(), at=both["ts"] - both["ts"].min())
    reach = int(both["at"].max()) + ttl_ms + 2
    both["at"] += both["part"] * reach  # one axis of time on which chunks do not touch
    asks, hits = both[both["intent_id"].notna()], both[both["intent_id"].isna()].sort_values(["at", "row_no"])
    time, n, out = hits["at"].to_numpy(), len(hits), []
    for buy in (True, False) if n else ():
        own = asks[asks["buy"] == buy]
        sign = 1.0 if buy else -1.0
        lowest, caps, ts = [sign * hits["price"].to_numpy()], sign * own["cap"].to_numpy(), own["at"].to_numpy()
        while 1 << len(lowest) <= n:  # the least of twice as many trades; beyond the last there is none
            half = 1 << len(lowest) - 1
            lowest.append(np.minimum(lowest[-1], np.concatenate((lowest[-1][half:], np.full(half, np.inf)))))
        at = np.searchsorted(time, ts, "right")
        for k in range(len(lowest) - 1, -1, -1):
            at = at + np.where((at < n) & (lowest[k][np.minimum(at, n - 1)] > caps), 1 << k, 0)
        met = at < np.searchsorted(time, ts + ttl_ms, "right")
        row = hits.iloc[at[met]]
        out.append(pd.DataFrame({"intent_id": own["intent_id"].to_numpy()[met], "fill_price": row["price"].to_numpy(), "_trade_qty": row["qty"].to_numpy(), "fill_ts_ms": row["ts"].to_numpy(), "trade_row": row["row_no"].to_numpy()}))
    return pd.concat(out) if out else pd.DataFrame({"intent_id": [], "fill_price": [], "_trade_qty": [], "fill_ts_ms": [], "trade_row": []})


def label_exits(entries: DataFrame, quotes: DataFrame, ttl_ms: int, take_profit_bps: float | None, stale_ms: int | None, z_exit: float = 0.4, adverse_z: float = 4.0, cost_bps: float = 0.0, leader: str = LEADER, lagger: str = LAGGER) -> DataFrame:
    """The first lagger quote after each entry that meets a barrier: exit_reason, exit_row, exit_ts_ms, exit_price and pnl.

    entries: entry_id, symbol, side, qty, entry_price, entry_ts_ms, model and, for the residual model, mean, sigma and beta.
    At one quote the order is stale leader, return of z, adverse z, take-profit, end of life. Entries do not affect
    each other. An entry that no quote ends stays open, with a null reason.

    Entries meet the ticks of their chunk of time (ttl_ms at least) and of the ttl_ms after it, so a tick is dealt out twice at most
    and no entry is paired with the ticks of its life: in a task the first tick that meets a barrier is found by descent over
    extremes of 1, 2, 4, ... ticks. A task holds the ticks of one symbol and chunk.
    """
    pairs = latest_pair(quotes.withColumn("mid", mid()), leader, lagger, event_order(), ["local_ts_ms", "mid"]).where(F.col("venue") == lagger)
    ticks = pairs.select("symbol", "row_no", F.col("local_ts_ms").alias("ts"), "bid", "ask", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), F.col("leader.local_ts_ms").alias("leader_ts"), F.col("leader.mid").alias("leader_mid"))
    ticks = kept(ticks, "ticks")  # both are read twice: by the search and by the ticks at the end of lives
    entries = kept(entries, "entries")
    own = entries.withColumn("expires_ts_ms", F.col("entry_ts_ms") + ttl_ms)
    early = _first_met(own, ticks, int(ttl_ms), take_profit_bps, stale_ms, z_exit, adverse_z)
    last = asof_forward(own, ticks, ["symbol"], F.struct(*ticks.columns[1:]), "_tick", left_ts="expires_ts_ms", right_ts="ts").where("_tick IS NOT NULL").select(*own.columns, "_tick.*")
    reason = _exit_reason(take_profit_bps, stale_ms, z_exit, adverse_z)
    columns = [*own.columns, "row_no", "ts", "bid", "ask", "mid", "leader_ts", "leader_mid"]
    hits = early.select(*columns).unionByName(last.select(*columns)).withColumn("exit_reason", reason).where("exit_reason IS NOT NULL")
    first = hits.groupBy("entry_id").agg(F.min_by(F.struct("exit_reason", F.col("row_no").alias("exit_row"), F.col("ts").alias("exit_ts_ms"), F.when(F.col("side") == "buy", F.col("bid")).otherwise(F.col("ask")).alias("exit_price")), F.struct("ts", "row_no")).alias("x"))
    out = entries.join(first, "entry_id", "left").select(*entries.columns, "x.*")
    gross, cost, net, bps = pnl_values("side", "entry_price", "exit_price", "qty", cost_bps)
    return out.withColumn("gross_pnl_usd", gross).withColumn("cost_usd", cost).withColumn("realized_pnl_usd", net).withColumn("pnl_bps", bps)


_INF = float("inf")


def _first_met(own: DataFrame, ticks: DataFrame, ttl_ms: int, take_profit_bps: float | None, stale_ms: int | None, z_exit: float, adverse_z: float, chunk_ms: int = HOUR_MS) -> DataFrame:
    """own with the first tick, after the entry and before its end, at which _exit_reason finds one; entries without such a tick leave.

    What the search compares is prepared here: a null never meets a barrier, and NaN is above all numbers, as Spark compares it.
    """
    width = max(ttl_ms, int(chunk_ms))
    beyond = lambda c, nan: F.when(F.isnan(c), F.lit(nan)).otherwise(c)
    late = F.lit(False) if stale_ms is None else F.coalesce(F.col("leader_ts").isNull() | (F.col("ts") - F.col("leader_ts") > stale_ms), F.lit(False))
    basis, lead = log_basis_bps(F.col("leader_mid"), F.col("mid"), 1.0), F.ln("leader_mid")
    chunk = lambda back: F.floor((F.col("ts") - back) / width)
    seen = ticks.where("ts IS NOT NULL").select(
        "symbol", F.explode(F.array_distinct(F.array(chunk(ttl_ms - 1), chunk(1)))).alias("chunk"), F.col("ts").alias("at"), F.col("row_no").alias("row"), F.struct(*ticks.columns).alias("tick"), late.alias("late"),
        F.col("bid").cast("double").alias("bid"), F.col("ask").cast("double").alias("ask"), beyond(basis, _INF).alias("basis"), F.when(basis.isNotNull(), beyond(lead, 0.0)).alias("lead"),
    )
    beta, worth = F.coalesce(F.nullif(F.col("beta").cast("double"), F.lit(0.0)), F.lit(1.0)), (F.col("entry_price") * F.col("qty")).cast("double")
    odd = F.isnan(beta) | F.isnan(F.col("mean").cast("double")) | F.isnan(F.col("sigma").cast("double"))
    by_z = F.coalesce((F.col("model") == "residual_zscore") & (F.col("sigma") > 0) & F.col("mean").isNotNull(), F.lit(False))
    asks = own.where("entry_ts_ms IS NOT NULL").select(
        "symbol", F.floor(F.col("entry_ts_ms") / width).alias("chunk"), F.col("entry_ts_ms").alias("at"), F.struct(*own.columns).alias("entry"), F.coalesce(F.col("side") == "buy", F.lit(False)).alias("buy"), by_z.alias("by_z"),
        F.when(odd, -_INF).otherwise(F.col("mean").cast("double")).alias("mean"), F.when(odd, 1.0).otherwise(F.col("sigma").cast("double")).alias("sigma"), F.when(odd, 0.0).otherwise(10000.0 * (1.0 - beta)).alias("tilt"),
        F.coalesce(F.abs(worth) > 0, F.lit(False)).alias("worth"), F.isnan(worth).alias("odd_worth"), F.col("entry_price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"),
    )
    both = asks.unionByName(seen, allowMissingColumns=True).repartition("symbol", "chunk").sortWithinPartitions("symbol", "chunk")
    limits = (ttl_ms, _INF if take_profit_bps is None else float(take_profit_bps), float(z_exit), float(adverse_z))
    found = both.mapInArrow(lambda batches: _met_by_chunk(batches, limits), both.select("entry", "tick").schema)
    return found.select("entry.*", *(F.col(f"tick.{c}").alias(c) for c in ticks.columns if c != "symbol"))


def _met_by_chunk(batches: Iterator[pa.RecordBatch], limits: tuple[int, float, float, float], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Whole chunks together, about `rows` rows at a time; batches come in the order of chunks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        whole = pa.Table.from_batches(held)
        part = _parts(whole)
        cut = int(np.searchsorted(part, part[-1]))  # the last chunk may go on
        held = whole.slice(cut).combine_chunks().to_batches()
        if cut:
            yield from _first_hits(whole.slice(0, cut), part[:cut], limits)
    if held:
        whole = pa.Table.from_batches(held)
        yield from _first_hits(whole, _parts(whole), limits)


def _parts(whole: pa.Table) -> np.ndarray:
    """The number of each row's symbol and chunk; rows come in their order."""
    names, chunks = (np.asarray(c.combine_chunks().dictionary_encode(null_encoding="encode").indices) if n == "symbol" else c.to_numpy() for n, c in ((n, whole.column(n)) for n in ("symbol", "chunk")))
    return np.cumsum(np.append(0, (names[1:] != names[:-1]) | (chunks[1:] != chunks[:-1])))


def _extremes(values: np.ndarray, none: float, least: bool) -> np.ndarray:
    """Extremes of 1, 2, 4, ... neighbours, one level after the other, from a power of two of values; none stands for no value."""
    size = 1 << max(0, len(values) - 1).bit_length()
    levels = [np.append(values, np.full(size - len(values), none))]
    while len(levels[-1]) > 1:
        levels.append((np.minimum if least else np.maximum)(levels[-1][::2], levels[-1][1::2]))
    return np.concatenate(levels)


def _first_hits(whole: pa.Table, part: np.ndarray, limits: tuple[int, float, float, float]) -> Iterator[pa.RecordBatch]:
    """Entries with the first tick of their chunk, later and within their life, that meets a barrier.

    A block of ticks holds one that meets a barrier if its extremes do. From its first tick an entry steps over blocks that hold
    none, to larger ones where they begin, and into the halves of a block that may.
    """
    ttl_ms, profit, z_exit, adverse_z = limits
    at, is_ask = whole.column("at").to_numpy(), np.asarray(whole.column("entry").combine_chunks().is_valid())
    at = at - at.min()
    at = at + part * (int(at.max()) + ttl_ms + 2)  # one axis of time on which chunks do not touch
    column = lambda name, pick, none: whole.column(name).take(pa.array(pick)).fill_null(none).to_numpy()
    asks, hits = np.flatnonzero(is_ask), np.flatnonzero(~is_ask)
    hits = hits[np.lexsort((column("row", hits, 0), at[hits]))]
    if not len(asks) or not len(hits):
        return
    buy, by_z, worth, odd_worth = (column(c, asks, False).astype(bool) for c in ("buy", "by_z", "worth", "odd_worth"))
    mean, sigma, tilt, price, qty = (column(c, asks, 0.0) for c in ("mean", "sigma", "tilt", "price", "qty"))
    late = _extremes(column("late", hits, False).astype(float), 0.0, False) > 0
    prices = {}
    for name in ("bid", "ask"):
        for least in (False, True):
            none = _INF if least else -_INF
            own = column(name, hits, none)
            prices[name, least] = _extremes(np.where(np.isnan(own), -none, own), none, least)
    basis_lo, basis_hi, lead_lo, lead_hi = (_extremes(column(name, hits, none), none, none > 0) for name in ("basis", "lead") for none in (_INF, -_INF))
    size = len(basis_lo) + 1 >> 1
    first_of = np.concatenate(([0], np.cumsum(size >> np.arange(size.bit_length()))))  # where each level begins
    best_is_high = buy == (qty > 0)

    def may_meet(who: np.ndarray, block: np.ndarray) -> np.ndarray:
        long, high = buy[who], best_is_high[who]
        best = np.where(long, np.where(high, prices["bid", False][block], prices["bid", True][block]), np.where(high, prices["ask", False][block], prices["ask", True][block]))
        gross = np.where(long, best - price[who], price[who] - best) * qty[who]
        gain = np.where(odd_worth[who], np.abs(best) != _INF, 10000.0 * gross / np.abs(price[who] * qty[who]) >= profit)
        gain = np.where(worth[who], gain, profit <= 0.0) & (profit != _INF)
        tilted = tilt[who] * lead_lo[block], tilt[who] * lead_hi[block]
        low, high = ((b[block] + f(*tilted) - mean[who]) / sigma[who] for b, f in ((basis_lo, np.minimum), (basis_hi, np.maximum)))
        back = np.where(long, (high >= -z_exit) | (low <= -adverse_z), (low <= z_exit) | (high >= adverse_z))
        return late[block] | gain | (by_z[who] & back)

    time = at[hits]
    spot, end = np.searchsorted(time, at[asks], "right"), np.searchsorted(time, at[asks] + ttl_ms, "left")
    level, who, met = np.zeros(len(asks), np.int64), np.flatnonzero(spot < end), np.full(len(asks), -1)
    with np.errstate(all="ignore"):
        while len(who):
            k, p = level[who], spot[who]
            meets = may_meet(who, first_of[k] + (p >> k))
            done = meets & (k == 0)
            met[who[done]] = p[done]
            p = np.where(meets, p, p + (1 << k))
            spot[who], level[who] = p, np.where(meets, k - 1, k + ((p >> k) % 2 == 0))
            who = who[~done & (p < end[who])]
    found = np.flatnonzero(met >= 0)
    out = pa.table({"entry": whole.column("entry").take(pa.array(asks[found])), "tick": whole.column("tick").take(pa.array(hits[met[found]]))})
    yield from out.combine_chunks().to_batches(max_chunksize=10_000)


def residual_exit_z() -> Column:
    """Current z of an entry's residual at a later tick, from the moments stored at entry; null without a positive sigma."""
    basis = log_basis_bps(F.col("leader_mid"), F.col("mid"), 1.0) + 10000.0 * (1.0 - F.coalesce(F.nullif(F.col("beta"), F.lit(0.0)), F.lit(1.0))) * F.ln("leader_mid")
    return F.when((F.col("model") == "residual_zscore") & F.col("leader_mid").isNotNull() & (F.col("sigma") > 0), (basis - F.col("mean")) / F.col("sigma"))


def _exit_reason(take_profit_bps: float | None, stale_ms: int | None, z_exit: float, adverse_z: float) -> Column:
    buy, z = F.col("side") == "buy", residual_exit_z()
    none = F.lit(None).cast("string")
    stale = F.lit(False) if stale_ms is None else F.col("leader_ts").isNull() | (F.col("ts") - F.col("leader_ts") > stale_ms)
    back = F.coalesce(F.when(buy, z >= -z_exit).otherwise(z <= z_exit), F.lit(False))
    adverse = F.coalesce(F.when(buy, z <= -adverse_z).otherwise(z >= adverse_z), F.lit(False))
    price = F.when(buy, F.col("bid")).otherwise(F.col("ask"))
    profit = F.lit(False) if take_profit_bps is None else pnl_values("side", "entry_price", price, "qty", 0.0)[3] >= take_profit_bps
    return F.when(stale, "stale_data_stop").when(back, "zscore_mean_reversion").when(adverse, "adverse_move_stop").when(profit, "take_profit").when(F.col("ts") >= F.col("expires_ts_ms"), "ttl_exit").otherwise(none)


def label_reversals(entries: DataFrame, intents: DataFrame, quotes: DataFrame) -> DataFrame:
    """Each entry with the earliest later intent of the other side on its symbol, and the exit price of the quote then current.

    The two sides of a symbol meet as an as-of join per side; nothing is paired that is not the answer.
    """
    other = intents.select("symbol", F.when(F.col("side") == "buy", "sell").otherwise("buy").alias("side"), "created_ts_ms", "intent_no", F.col("intent_id").alias("by"))
    found = asof_forward(entries, other, ["symbol", "side"], F.struct("by", "created_ts_ms"), "_r", left_ts="entry_ts_ms", right_ts="created_ts_ms", right_order=["intent_no"], strict=True)
    found = found.where("_r IS NOT NULL").withColumn("reversal_ts_ms", F.col("_r.created_ts_ms")).withColumn("reversed_by", F.col("_r.by")).drop("_r")
    priced = asof_backward(found, quotes, ["symbol"], F.struct("bid", "ask"), "_q", left_ts="reversal_ts_ms")
    return priced.withColumn("exit_price", F.when(F.col("side") == "buy", F.col("_q.bid")).otherwise(F.col("_q.ask"))).drop("_q")


def mark_to_market(positions: DataFrame, quotes: DataFrame, cost_bps: float) -> DataFrame:
    """Unrealised gross, cost and net by symbol at the latest quote; symbols without a quote count 0."""
    latest = quotes.groupBy("symbol").agg(F.max_by(F.struct("bid", "ask"), F.struct("local_ts_ms", "row_no")).alias("q"))
    own = positions.join(latest, "symbol", "left").withColumn("mark", F.when(F.col("side") == "buy", F.col("q.bid")).otherwise(F.col("q.ask")))
    gross, cost, net, _ = pnl_values("side", "entry_price", "mark", "qty", cost_bps)
    return own.groupBy("symbol").agg(*(F.sum(F.coalesce(v, F.lit(0.0))).alias(n) for v, n in ((gross, "gross_usd"), (cost, "cost_usd"), (net, "net_usd"))))


def exposure_timeline(fills: DataFrame) -> DataFrame:
    """State after each opening and closing: open positions, notionals, per-direction counts and realised profit.

    fills: position_id, symbol, side, notional, entry_ts_ms, exit_ts_ms (null while open) and realized_pnl_usd.
    At one time closings come first.
    """
    pnl = F.col("realized_pnl_usd")
    ends = F.array(F.struct(F.lit(0).cast(fills.schema["realized_pnl_usd"].dataType).alias("pnl"), F.col("entry_ts_ms").alias("ts"), F.lit(1).alias("change")), F.struct(pnl.alias("pnl"), F.col("exit_ts_ms").alias("ts"), F.lit(-1).alias("change")))
    moves = fills.select("position_id", "symbol", "side", "notional", F.explode(ends).alias("m")).select("position_id", "symbol", "side", "notional", "m.*").where("change = 1 OR ts IS NOT NULL")
    order = [F.col("ts"), F.col("change"), F.col("position_id")]
    delta = F.col("change") * F.col("notional")
    long = F.when(F.col("side") == "buy", F.col("change")).otherwise(0)
    own = running_sums(moves, ["symbol"], "ts", order, {"symbol_notional": delta, "long_count": long, "short_count": F.col("change") - long})
    return running_sums(own, [], "ts", order, {"open_positions": F.col("change"), "total_notional": delta, "realized_pnl": F.col("pnl")}, chunk_ms=HOUR_MS)
