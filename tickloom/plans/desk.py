"""Queries on the universe, risk checks and order reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import orders, risk, universe
from tickloom.operators.asof import Timeline, asof_many
from tickloom.plans.market import HOUR
from tickloom.plans.registry import Tables, query

_CAND = """c AS (SELECT symbol, leader_enabled, lagger_enabled, symbol NOT LIKE '%77USDT' AS api_allowed, leader_volume, lagger_volume, leader_depth, lagger_depth, spread_bps / 2 AS leader_spread_bps, spread_bps AS lagger_spread_bps, tick_bps, tick_bps + 6 AS fee_bps, CAST(0 AS DOUBLE) AS noise_bps, CAST(1 AS DOUBLE) AS cost FROM universe),
 f AS (SELECT *, CASE WHEN NOT leader_enabled THEN 'leader_trading_disabled' WHEN NOT lagger_enabled THEN 'lagger_trading_disabled' WHEN NOT api_allowed THEN 'lagger_api_not_allowed' WHEN least(leader_volume, lagger_volume) < 1000000 THEN 'quote_volume_too_low'
 WHEN greatest(leader_spread_bps, lagger_spread_bps) > 12 THEN 'spread_too_wide' WHEN least(leader_depth, lagger_depth) < 10000 THEN 'top5_depth_too_low' WHEN tick_bps > 4 THEN 'mexc_tick_too_coarse' ELSE 'ok' END AS reason FROM c),
 s AS (SELECT *, 0.3 * least(greatest(least(leader_volume, lagger_volume) / 100000000, 0), 1) + 0.2 * least(greatest(least(leader_depth, lagger_depth) / 1000000, 0), 1) - 0.15 * least(greatest(leader_spread_bps, lagger_spread_bps) / 30, 1) - 0.1 * least(tick_bps / 10, 1) - 0.1 * least(fee_bps / 20, 1) - 0.05 * 0.1 AS score FROM f)"""


def _candidates(t: Tables) -> DataFrame:
    u = t.universe
    return u.select("symbol", "leader_enabled", "lagger_enabled", (~F.col("symbol").endswith("77USDT")).alias("api_allowed"), "leader_volume", "lagger_volume", "leader_depth", "lagger_depth", (F.col("spread_bps") / 2).alias("leader_spread_bps"), F.col("spread_bps").alias("lagger_spread_bps"), "tick_bps", (F.col("tick_bps") + 6).alias("fee_bps"), F.lit(0.0).alias("noise_bps"), F.lit(1.0).alias("cost"))


def _filtered(t: Tables) -> DataFrame:
    return universe.universe_filter(_candidates(t), 1_000_000, 12, 10_000, 4)


@query("build_symbol_profiles", "SELECT symbol AS canonical_symbol, symbol AS leader_symbol, replace(symbol, 'USDT', '_USDT') AS lagger_symbol, 'perp_to_perp' AS profile, 'usdt_perp' AS leader_market, 'usdt_perp' AS lagger_market FROM universe", "universe")
def build_symbol_profiles(t: Tables) -> DataFrame:
    return universe.build_symbol_profiles(t.universe.select(F.lower("symbol").alias("symbol")), "perp_to_perp")


def _snapshots(t: Tables) -> DataFrame:
    """Six snapshots out of the universe view, each with some symbols missing, joined again."""
    u = t.universe.withColumn("k", F.expr("try_cast(regexp_extract(symbol, '([0-9]+)', 1) AS BIGINT)"))
    part = lambda modulus, name, *cols: u.where(F.col("k") % modulus != 0).select("symbol", F.struct(*cols).alias(name))
    book = lambda half: (F.lit(100.0 - half).alias("bid"), F.lit(100.0 + half).alias("ask"))
    rate = lambda d: F.when(F.col("k") % d == 0, F.lit(None).cast("double")).otherwise(F.col("k") % d / 10000.0)
    info = part(7, "lagger_info", F.col("lagger_enabled").alias("trading_enabled"), F.lit(True).alias("api_allowed"), (F.col("tick_bps") / 100).alias("price_tick"), rate(3).alias("maker_fee_rate"), rate(4).alias("taker_fee_rate"))
    return universe.intersect_snapshots(
        part(5, "leader_info", F.col("leader_enabled").alias("trading_enabled")), part(6, "leader_stats", F.col("leader_volume").alias("quote_volume")), part(11, "leader_book", *book(0.01)), info, part(8, "lagger_stats", F.col("lagger_volume").alias("quote_volume")), part(9, "lagger_book", *book(0.02)),
    )


_SHARED = "k AS (SELECT *, CAST(regexp_extract(symbol, '([0-9]+)', 1) AS BIGINT) AS k FROM universe), sh AS (SELECT * FROM k WHERE k % 5 <> 0 AND k % 6 <> 0 AND k % 11 <> 0 AND k % 7 <> 0 AND k % 8 <> 0 AND k % 9 <> 0)"


@query("intersect_snapshots", f"WITH {_SHARED} SELECT symbol, leader_volume, lagger_volume FROM sh", "universe")
def intersect_snapshots(t: Tables) -> DataFrame:
    return _snapshots(t).select("symbol", F.col("leader_stats.quote_volume").alias("leader_volume"), F.col("lagger_stats.quote_volume").alias("lagger_volume"))


@query(
    "universe_candidates",
    f"WITH {_SHARED} SELECT symbol, round(10000 * 0.04 / 100, 6) AS lagger_spread_bps, round(10000 * (tick_bps / 100) / 100, 6) AS tick_bps, CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE k % 3 END + CASE WHEN k % 4 = 0 THEN 6 ELSE k % 4 END AS DOUBLE) AS fee_bps FROM sh", "universe",
)
def universe_candidates(t: Tables) -> DataFrame:
    joined = _snapshots(t).withColumn("leader_depth", F.lit(1.0)).withColumn("lagger_depth", F.lit(1.0))
    return universe.universe_candidates(joined).select("symbol", *(F.round(c, 6).alias(c) for c in ("lagger_spread_bps", "tick_bps", "fee_bps")))


@query("symbol_intersection", "SELECT DISTINCT symbol FROM quotes WHERE venue = 'binance' INTERSECT SELECT DISTINCT symbol FROM quotes WHERE venue = 'mexc' INTERSECT SELECT symbol FROM trades", "quotes", "trades")
def symbol_intersection(t: Tables) -> DataFrame:
    q = t.quotes
    return q.where("venue = 'binance'").select("symbol").intersect(q.where("venue = 'mexc'").select("symbol")).intersect(t.trades.select("symbol"))


@query("coarse_top_k", "SELECT symbol, least(leader_volume, lagger_volume) AS volume FROM universe ORDER BY volume DESC, symbol LIMIT 50", "universe")
def coarse_top_k(t: Tables) -> DataFrame:
    return universe.coarse_top_k(t.universe, 50).select("symbol", F.least("leader_volume", "lagger_volume").alias("volume"))


@query("universe_filter", f"WITH {_CAND} SELECT symbol, reason, reason = 'ok' AS allowed FROM s", "universe")
def universe_filter(t: Tables) -> DataFrame:
    return _filtered(t).select("symbol", "reason", "allowed")


@query("universe_rank", f"WITH {_CAND} SELECT symbol, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, symbol) AS rank FROM s WHERE reason = 'ok' QUALIFY rank <= 100", "universe")
def universe_rank(t: Tables) -> DataFrame:
    return universe.universe_rank(_filtered(t).where("allowed"), 100).select("symbol", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("universe_profiles", f"WITH {_CAND}, r AS (SELECT symbol, row_number() OVER (ORDER BY score DESC, symbol) AS rank FROM s WHERE reason = 'ok' QUALIFY rank <= 20) SELECT symbol, replace(symbol, 'USDT', '_USDT') AS lagger_symbol, rank, CAST(2 AS DOUBLE) AS maker_fee_bps, 'ok' AS filter_reason FROM r", "universe")
def universe_profiles(t: Tables) -> DataFrame:
    info = t.universe.select("symbol", F.lit(1.0).alias("min_qty"), F.lit(1.0).alias("qty_step"), F.lit(0.01).alias("price_tick"), F.lit(5.0).alias("min_notional"), F.lit(0.0002).alias("maker_fee_rate"), F.lit(0.0006).alias("taker_fee_rate"))
    own = universe.universe_profiles(universe.universe_rank(_filtered(t).where("allowed"), 20), info, "perp_to_perp")
    return own.select("symbol", "lagger_symbol", F.col("rank").cast("long").alias("rank"), F.round("maker_fee_bps", 6).alias("maker_fee_bps"), F.col("metadata")["filter_reason"].alias("filter_reason"))


def _scored(t: Tables) -> DataFrame:
    return t.universe.select("symbol", F.when(F.col("spread_bps") == 0, "n/a").otherwise(F.col("lagger_depth").cast("string")).alias("universe_score"))


@query("live_profiles_top_n", "SELECT symbol, CASE WHEN spread_bps = 0 THEN 0 ELSE lagger_depth END AS score FROM universe ORDER BY score DESC, symbol LIMIT 30", "universe")
def live_profiles_top_n(t: Tables) -> DataFrame:
    return universe.live_profiles_top_n(_scored(t), 40, 30).select("symbol", "score")


@query(
    "universe_rotation",
    "WITH n AS (SELECT symbol FROM universe ORDER BY CASE WHEN spread_bps = 0 THEN 0 ELSE lagger_depth END DESC, symbol LIMIT 30), cur AS (SELECT symbol FROM universe WHERE lagger_depth > 90000) SELECT CASE WHEN cur.symbol IS NULL THEN 'subscribe' WHEN n.symbol IS NULL THEN 'unsubscribe' ELSE 'keep' END AS action, coalesce(n.symbol, cur.symbol) AS symbol FROM n FULL JOIN cur ON n.symbol = cur.symbol",
    "universe",
)
def universe_rotation(t: Tables) -> DataFrame:
    return universe.universe_rotation(t.universe.where("lagger_depth > 90000"), _scored(t), 30)


@query("feed_risk_flags", f"""WITH b AS (SELECT symbol, local_ts_ms AS ts FROM quotes WHERE venue = 'binance' GROUP BY ALL), m AS (SELECT symbol, local_ts_ms AS ts FROM quotes WHERE venue = 'mexc' GROUP BY ALL), i1 AS (SELECT i.*, b.ts AS bt FROM intents i ASOF LEFT JOIN b ON i.symbol = b.symbol AND i.created_ts_ms >= b.ts),
 i2 AS (SELECT i1.*, m.ts AS mt FROM i1 ASOF LEFT JOIN m ON i1.symbol = m.symbol AND i1.created_ts_ms >= m.ts)
 SELECT intent_id, bt IS NULL OR (mt IS NOT NULL AND created_ts_ms - bt > {3 * HOUR}) AS leader_stale, mt IS NULL OR (bt IS NOT NULL AND created_ts_ms - mt > {3 * HOUR}) AS lagger_stale FROM i2""", "intents", "quotes")  # fmt: skip
def feed_risk_flags(t: Tables) -> DataFrame:
    return risk.feed_risk_flags(t.intents, t.quotes, 3 * HOUR).select("intent_id", "leader_stale", "lagger_stale")


# positions that intents open, some still open at the end
_POSITIONS = f"""po AS (SELECT intent_no AS position_id, symbol, side, CAST(floor(qty * price_cap) AS DECIMAL(18,2)) AS notional, created_ts_ms + 1 AS entry_ts, CASE WHEN intent_no % 211 > 0 THEN created_ts_ms + (1 + intent_no % 7) * {HOUR} END AS exit_ts, CAST(intent_no % 11 - 6 AS DECIMAL(18,2)) AS pnl FROM intents WHERE intent_no % 5 = 0),
 mv AS (SELECT position_id, symbol, side, notional, CAST(0 AS DECIMAL(18,2)) AS pnl, entry_ts AS ts, 1 AS c FROM po UNION ALL SELECT position_id, symbol, side, -notional, pnl, exit_ts, -1 FROM po WHERE exit_ts IS NOT NULL),
 un AS (SELECT NULL AS intent_no, symbol, side AS way, ts, 0 AS rk, c, position_id, notional, pnl FROM mv UNION ALL SELECT intent_no, symbol, NULL, created_ts_ms, 1, NULL, NULL, NULL, NULL FROM intents),
 us AS (SELECT *, coalesce(sum(notional) OVER w, 0) AS sym, coalesce(sum(CASE WHEN way = 'buy' THEN c END) OVER w, 0) AS lc, coalesce(sum(CASE WHEN way <> 'buy' THEN c END) OVER w, 0) AS sc FROM un WINDOW w AS (PARTITION BY symbol ORDER BY ts, rk, c, position_id ROWS UNBOUNDED PRECEDING)),
 ua AS (SELECT *, CASE WHEN c > 0 AND lc + sc = 1 THEN 1 WHEN c < 0 AND lc + sc = 0 THEN -1 ELSE 0 END AS woke FROM us),
 ug AS (SELECT intent_no, sym, lc, sc, coalesce(sum(c) OVER w, 0) AS op, coalesce(sum(notional) OVER w, 0) AS tot, sum(woke) OVER w AS active, coalesce(sum(pnl) OVER d, 0) AS day_pnl FROM ua WINDOW w AS (ORDER BY ts, rk, c, position_id ROWS UNBOUNDED PRECEDING), d AS (PARTITION BY ts // 86400000 ORDER BY ts, rk, c, position_id ROWS UNBOUNDED PRECEDING))"""


@query(
    "risk_gate",
    f"""WITH {_POSITIONS}, lg AS (SELECT symbol, local_ts_ms AS ts FROM quotes WHERE venue = 'mexc' GROUP BY ALL), i1 AS (SELECT i.*, lg.ts AS mt FROM intents i ASOF LEFT JOIN lg ON i.symbol = lg.symbol AND i.created_ts_ms >= lg.ts),
 s AS (SELECT i1.*, ug.* EXCLUDE (intent_no), CASE WHEN side = 'buy' THEN lc ELSE sc END AS dir FROM i1 JOIN ug ON ug.intent_no = i1.intent_no)
 SELECT intent_id, CASE WHEN i1_no % 50 = 0 THEN 'manual_kill_switch' WHEN mt IS NULL OR created_ts_ms - mt > {6 * HOUR} THEN 'mexc_feed_stale' WHEN i1_no % 41 = 0 THEN 'bridge_disconnected' WHEN expected_edge_bps <= 0 THEN 'non_positive_edge' WHEN day_pnl <= -6 THEN 'max_daily_loss_reached'
 WHEN op >= 8 THEN 'max_open_positions_reached' WHEN dir > 0 THEN 'symbol_direction_position_exists' WHEN lc + sc = 0 AND active >= 5 THEN 'max_active_symbols_reached' WHEN tot + abs(qty * price_cap) > 2500 THEN 'max_total_notional_reached' WHEN sym + abs(qty * price_cap) > 700 THEN 'max_symbol_notional_reached' ELSE 'ok' END AS risk_reason,
 CAST(op AS BIGINT) AS open_positions, CAST(active AS BIGINT) AS active_symbols, CAST(dir AS BIGINT) AS direction_count, CAST(tot AS DOUBLE) AS total_notional, CAST(sym AS DOUBLE) AS symbol_notional, CAST(day_pnl AS DOUBLE) AS daily_pnl FROM (SELECT *, intent_no AS i1_no FROM s)""",
    "intents", "quotes",
)
def risk_gate(t: Tables) -> DataFrame:
    """Intents against the exposure that fills have built up by then, the lagging feed and switches."""
    n = F.col("intent_no")
    fills = t.intents.where(n % 5 == 0).select(
        n.alias("position_id"), "symbol", "side", F.floor(F.col("qty") * F.col("price_cap")).cast("decimal(18,2)").alias("notional"), (F.col("created_ts_ms") + 1).alias("entry_ts_ms"),
        F.when(n % 211 > 0, F.col("created_ts_ms") + (1 + n % 7) * HOUR).alias("exit_ts_ms"), (n % 11 - 6).cast("decimal(18,2)").alias("realized_pnl_usd"),
    )
    own = asof_many(t.intents, {"last_ts": Timeline(t.quotes.where("venue = 'mexc'"), F.col("local_ts_ms"))}, ["symbol"], "created_ts_ms")
    stale = F.col("last_ts").isNull() | (F.col("created_ts_ms") - F.col("last_ts") > 6 * HOUR)
    own = risk.entry_state(own.withColumn("flags", F.create_map(F.lit("kill_switch"), n % 50 == 0, F.lit("mexc_feed_stale"), stale)).withColumn("bridge_connected", n % 41 != 0), fills)
    gated = risk.risk_gate(own, 6.0, 8, 5, 2500.0, 700.0)
    return gated.select("intent_id", "risk_reason", *(F.col(c).cast("long").alias(c) for c in ("open_positions", "active_symbols", "direction_count")), *(F.col(c).cast("double").alias(c) for c in ("total_notional", "symbol_notional", "daily_pnl")))


@query(
    "validate_orders",
    "SELECT intent_id, CASE WHEN price_cap <= 0 THEN 'price_must_be_positive' WHEN symbol = 'S7USDT' THEN 'symbol_profile_mismatch' WHEN qty < 2 THEN 'qty_below_min' WHEN CAST(qty AS BIGINT) % 2 <> 0 THEN 'qty_step_mismatch' WHEN CAST(price AS DECIMAL(18,4)) % 0.05 <> 0 THEN 'price_tick_mismatch' WHEN abs(qty * price) < 300 THEN 'notional_below_min' ELSE 'ok' END AS reason FROM (SELECT *, round(price_cap, 2) AS price FROM intents)",
    "intents",
)
def validate_orders(t: Tables) -> DataFrame:
    profiles = t.intents.select(F.col("symbol").alias("profile_symbol")).distinct().where("profile_symbol <> 'S7USDT'").select("profile_symbol", F.lit(2.0).alias("min_qty"), F.lit(2.0).alias("qty_step"), F.lit(0.05).alias("price_tick"), F.lit(300.0).alias("min_notional"), F.lit(1.0).alias("contract_size"))
    return risk.validate_orders(t.intents.withColumn("price_cap", F.round("price_cap", 2)), profiles).select("intent_id", "reason")


_TL = """j AS (SELECT u.*, o.symbol, o.qty, o.status FROM order_updates u JOIN open_orders o USING (client_order_id)), w AS (SELECT *, greatest(0, coalesce(max(CASE WHEN event_type = 'fill' THEN filled_qty END) OVER (PARTITION BY client_order_id ORDER BY row_no), 0)) AS fm FROM j),
 a AS (SELECT *, CASE WHEN event_type = 'fill' THEN CASE WHEN fm >= qty THEN 'filled' ELSE 'partially_filled' END ELSE event_type END AS after_status FROM w),
 tl AS (SELECT *, coalesce(lag(after_status) OVER (PARTITION BY client_order_id ORDER BY row_no), status) AS before_status FROM a)"""


# updates with venue ids, reasons, rejections, unknown kinds and prices of 0
_MIXED = """mx AS (SELECT u.row_no, u.client_order_id, CASE WHEN u.row_no % 17 = 0 THEN 'rejected' WHEN u.row_no % 19 = 0 THEN 'noted' ELSE u.event_type END AS event_type, u.filled_qty, CASE WHEN u.row_no % 5 = 0 THEN 0 ELSE u.avg_fill_price END AS price, CASE WHEN u.row_no % 3 = 0 THEN '' ELSE concat('v', u.row_no) END AS venue_id, CASE WHEN u.row_no % 2 = 0 THEN concat('r', u.row_no) END AS reason, o.qty, o.status FROM order_updates u JOIN open_orders o USING (client_order_id)),
 my AS (SELECT *, greatest(0, coalesce(max(CASE WHEN event_type = 'fill' THEN filled_qty END) OVER (PARTITION BY client_order_id ORDER BY row_no), 0)) AS fm FROM mx), mz AS (SELECT *, CASE WHEN event_type = 'fill' THEN CASE WHEN fm >= qty THEN 'filled' ELSE 'partially_filled' END WHEN event_type IN ('accepted', 'cancelled', 'rejected') THEN event_type END AS st FROM my),
 ml AS (SELECT *, coalesce(last_value(st IGNORE NULLS) OVER w, status) AS after_status, last_value(CASE WHEN event_type = 'fill' AND price <> 0 THEN price END IGNORE NULLS) OVER w AS last_price, last_value(CASE WHEN event_type IN ('accepted', 'fill', 'cancelled') AND venue_id <> '' THEN venue_id END IGNORE NULLS) OVER w AS venue_order_id,
 max(CASE WHEN event_type = 'rejected' THEN row_no END) OVER w AS rejected_at FROM mz WINDOW w AS (PARTITION BY client_order_id ORDER BY row_no ROWS UNBOUNDED PRECEDING))"""


@query(
    "order_state_timeline",
    f"WITH {_MIXED} SELECT ml.row_no, fm AS filled_max, coalesce(lag(after_status) OVER (PARTITION BY ml.client_order_id ORDER BY ml.row_no), status) AS before_status, after_status, after_status IN ('accepted', 'partially_filled') AS open_after, last_price AS avg_fill_price, venue_order_id, CASE WHEN rejected_at % 2 = 0 THEN concat('r', rejected_at) END AS reject_reason FROM ml",
    "order_updates", "open_orders",
)
def order_state_timeline(t: Tables) -> DataFrame:
    return orders.order_state_timeline(t.open_orders, mixed_updates(t)).select("row_no", "filled_max", "before_status", "after_status", "open_after", "avg_fill_price", "venue_order_id", "reject_reason")


def mixed_updates(t: Tables) -> DataFrame:
    n = F.col("row_no")
    updates = t.order_updates.withColumn("event_type", F.when(n % 17 == 0, "rejected").when(n % 19 == 0, "noted").otherwise(F.col("event_type"))).withColumn("avg_fill_price", F.when(n % 5 == 0, 0.0).otherwise(F.col("avg_fill_price")))
    return updates.withColumn("venue_order_id", F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("v"), n.cast("string")))).withColumn("reason", F.when(n % 2 == 0, F.concat(F.lit("r"), n.cast("string"))))


#: The last state of every order that has updates.
MIXED_FINAL = f"""WITH {_MIXED} SELECT client_order_id, after_status AS status, fm AS filled_qty, last_price AS avg_fill_price, venue_order_id, CASE WHEN rejected_at % 2 = 0 THEN concat('r', rejected_at) END AS reject_reason, after_status IN ('accepted', 'partially_filled') AS open FROM ml QUALIFY row_number() OVER (PARTITION BY client_order_id ORDER BY row_no DESC) = 1"""


_FINAL = f"""{_TL}, l AS (SELECT client_order_id, max_by(after_status, row_no) AS st, max(fm) AS fm FROM tl GROUP BY 1), fin AS (SELECT o.client_order_id, coalesce(l.st, o.status) AS status, coalesce(l.fm, 0) AS filled_qty, coalesce(l.st, o.status) IN ('accepted', 'partially_filled') AS open, o.expires_ts_ms FROM open_orders o LEFT JOIN l USING (client_order_id))"""


@query("order_state_final", f"WITH {_FINAL} SELECT client_order_id, status, filled_qty, open FROM fin", "order_updates", "open_orders")
def order_state_final(t: Tables) -> DataFrame:
    return orders.order_state_final(t.open_orders, t.order_updates).select("client_order_id", "status", "filled_qty", "open")


@query("ttl_expired_orders", f"WITH {_FINAL} SELECT client_order_id, expires_ts_ms FROM fin WHERE open AND expires_ts_ms <= 900000000000", "order_updates", "open_orders")
def ttl_expired_orders(t: Tables) -> DataFrame:
    return orders.ttl_expired_orders(orders.order_state_final(t.open_orders, t.order_updates), 900_000_000_000).select("client_order_id", "expires_ts_ms")


@query("match_updates_to_orders", "SELECT row_no, client_order_id, symbol FROM order_updates JOIN open_orders USING (client_order_id)", "order_updates", "open_orders")
def match_updates_to_orders(t: Tables) -> DataFrame:
    return orders.match_updates(t.open_orders, t.order_updates).select("row_no", "client_order_id", "symbol")


@query("unmatched_updates", "SELECT row_no, client_order_id FROM order_updates WHERE client_order_id NOT IN (SELECT client_order_id FROM open_orders)", "order_updates", "open_orders")
def unmatched_updates(t: Tables) -> DataFrame:
    return orders.unmatched_updates(t.open_orders, t.order_updates).select("row_no", "client_order_id")


@query(
    "reconciliation_summary",
    "SELECT count(*) AS updates, count(*) + count(*) FILTER (row_no % 10 = 1) AS audit_records, 2 * count(*) FILTER (row_no % 10 = 1) AS positions, count(*) FILTER (row_no % 10 = 2) AS balances, count(*) FILTER (row_no % 10 NOT IN (1, 2, 3) AND o.client_order_id IS NULL) AS unmatched_updates, count(*) FILTER (row_no % 10 = 3) AS unknown_updates, (SELECT count(*) FROM open_orders) AS orders FROM order_updates u LEFT JOIN open_orders o USING (client_order_id)",
    "order_updates", "open_orders",
)
def reconciliation_summary(t: Tables) -> DataFrame:
    return orders.reconciliation_summary(t.open_orders, orders.classify_private_updates(orders.expand_private_updates(raw_updates(t))))


@query("orders_from_submissions", "SELECT concat('llb-', intent_no) AS client_order_id, CASE WHEN intent_no % 5 = 0 THEN 'unknown' WHEN intent_no % 3 = 0 THEN 'accepted' WHEN intent_no % 3 = 1 THEN 'planned' ELSE 'rejected' END AS status, intent_no % 5 = 0 OR intent_no % 3 = 0 AS open, CASE WHEN intent_no % 5 = 0 OR intent_no % 3 = 0 THEN created_ts_ms + 3000 END AS expires_ts_ms FROM intents", "intents")
def orders_from_submissions(t: Tables) -> DataFrame:
    n = F.col("intent_no")
    own = t.intents.select(F.concat(F.lit("llb-"), n.cast("string")).alias("client_id"), F.lit(None).cast("string").alias("client_id_returned"), "symbol", "qty", (n % 5 == 0).alias("unknown_status"), F.when(n % 3 == 0, "accepted").when(n % 3 == 1, "dry_run_planned").otherwise("http_error").alias("decision_result"), F.col("created_ts_ms").alias("now_ts_ms"))
    return orders.orders_from_submissions(own, 3000).select("client_order_id", "status", "open", "expires_ts_ms")


def raw_updates(t: Tables, *extra: Column) -> DataFrame:
    """Private updates as JSON in the shapes that the bridge sends, out of the order updates."""
    n, i = F.col("row_no"), F.col("client_order_id")
    single = F.to_json(F.struct(F.lit("OrderUpdate").alias("Type"), F.struct(i.alias("ClientId"), F.when(F.col("event_type") == "cancelled", "canceled").otherwise(F.col("event_type")).alias("Status"), F.when(F.col("event_type") == "fill", F.col("filled_qty")).alias("FilledQty"), F.col("ts_ms").alias("Timestamp"), F.when(n % 4 == 0, F.concat(F.lit("r"), n.cast("string"))).alias("Reason"), F.when(n % 3 == 0, F.concat(F.lit("m"), n.cast("string"))).alias("message")).alias("Data")))
    link = F.when(n % 20 == 1, '"ConnectionId":7').otherwise('"connectionId":"c7"')
    listed = F.concat(F.lit('{"Type":"Positions","Data":{'), link, F.lit(',"Positions":[{"Symbol":"A","Qty":'), F.col("filled_qty").cast("int").cast("string"), F.lit('},{"Symbol":"B","Size":"2"}]}}'))
    balance = F.concat(F.lit('{"type":"wallet","data":{"Asset":"USDT","Free":"'), F.col("filled_qty").cast("int").cast("string"), F.lit('"}}'))
    odd = F.lit('{"hello":1}')
    return t.order_updates.select("row_no", *extra, F.when(n % 10 == 1, listed).when(n % 10 == 2, balance).when(n % 10 == 3, odd).otherwise(single).alias("body"))


@query("expand_private_updates", "SELECT row_no, i AS item_no, CASE WHEN row_no % 20 = 1 THEN '7' WHEN row_no % 10 = 1 THEN 'c7' END AS connection_id, row_no % 20 = 11 AS lower_case FROM order_updates, (VALUES (0), (1)) AS v(i) WHERE i = 0 OR row_no % 10 = 1", "order_updates")
def expand_private_updates(t: Tables) -> DataFrame:
    own = orders.expand_private_updates(raw_updates(t))
    upper, lower = F.get_json_object("payload", "$.ConnectionId"), F.get_json_object("payload", "$.connectionId")
    return own.select("row_no", F.col("item_no").cast("long").alias("item_no"), F.coalesce(upper, lower).alias("connection_id"), lower.isNotNull().alias("lower_case"))


@query(
    "classify_private_updates",
    "SELECT row_no, i AS item_no, CASE row_no % 10 WHEN 1 THEN 'position' WHEN 2 THEN 'balance' WHEN 3 THEN 'unknown' ELSE 'order' END AS kind, CASE WHEN row_no % 10 = 1 THEN CASE WHEN i = 0 THEN floor(filled_qty) ELSE 2 END END AS qty, CASE WHEN row_no % 10 = 2 THEN floor(filled_qty) END AS available, CASE WHEN row_no % 10 IN (1, 2, 3) THEN NULL WHEN row_no % 4 = 0 THEN concat('r', row_no) WHEN row_no % 3 = 0 THEN concat('m', row_no) END AS reason FROM order_updates, (VALUES (0), (1)) AS v(i) WHERE i = 0 OR row_no % 10 = 1",
    "order_updates",
)
def classify_private_updates(t: Tables) -> DataFrame:
    own = orders.classify_private_updates(orders.expand_private_updates(raw_updates(t)))
    return own.select("row_no", F.col("item_no").cast("long").alias("item_no"), "kind", F.when(F.col("kind") == "position", F.col("qty")).alias("qty"), F.when(F.col("kind") == "balance", F.col("available")).alias("available"), "reason")


@query("order_event_type", "SELECT row_no, event_type FROM order_updates WHERE row_no % 10 > 3 OR row_no % 10 = 0", "order_updates")
def order_event_type(t: Tables) -> DataFrame:
    own = orders.classify_private_updates(orders.expand_private_updates(raw_updates(t))).where("kind = 'order'")
    return own.select("row_no", F.col("order_event").alias("event_type"))
