"""Queries on signals, leadership and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import exprs as E
from tickloom.operators import leadlag, outcomes, signals
from tickloom.plans.market import BASIS, HOUR, ORDER, PAIRS, depth_snapshots, ewm_sql
from tickloom.plans.registry import Tables, query

LAGS = [HOUR // 2, HOUR, 2 * HOUR, 4 * HOUR]
WINDOWS = (HOUR, 2 * HOUR, 4 * HOUR, 8 * HOUR)


def _rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in columns else c for c in df.columns))


GREEDY = f"""f AS (SELECT symbol, j, ts AS last, true AS kept FROM n WHERE j = 1 UNION ALL
 SELECT n.symbol, n.j, CASE WHEN n.ts - f.last >= {2 * HOUR} THEN n.ts ELSE f.last END, n.ts - f.last >= {2 * HOUR} FROM f JOIN n ON n.symbol = f.symbol AND n.j = f.j + 1)"""


@query(
    "residual_signals",
    ewm_sql(12 * HOUR)
    + f""", m AS (SELECT row_no, symbol, coalesce(CASE WHEN r > 0 THEN 10000 * (mid - r) / r END, CASE WHEN r <= 0 THEN 0 END) AS move FROM (SELECT row_no, symbol, mid, lag(mid) OVER (PARTITION BY symbol ORDER BY {ORDER}) AS r FROM q WHERE venue = 'binance')),
 z AS (SELECT s.row_no, s.symbol, s.ts, s.k, s.basis, s.a, s.b, e.prior_mean AS mean, greatest(sqrt(greatest(e.prior_var, 0)), 0.5) AS sigma, m.move FROM s JOIN e ON s.symbol = e.symbol AND s.k = e.k JOIN m ON m.row_no = s.a.row_no WHERE s.k > 10 AND m.move IS NOT NULL),
 c AS (SELECT *, (basis - mean) / sigma AS zs, abs(basis - mean) - 2 AS edge FROM z), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, row_no) AS j FROM c WHERE edge > 0 AND ((move > 0 AND zs <= -1.5) OR (move < 0 AND zs >= 1.5))), {GREEDY}
 SELECT n.row_no, n.symbol, n.ts, CASE WHEN move > 0 THEN 'buy' ELSE 'sell' END AS side, round(CASE WHEN move > 0 THEN b.ask ELSE b.bid END, 6) AS price_cap, round(edge, 3) AS edge_bps, round(zs, 3) AS z_score
 FROM n JOIN f ON n.symbol = f.symbol AND n.j = f.j WHERE f.kept""",
    "quotes",
)
def residual_signals(t: Tables) -> DataFrame:
    found = signals.residual_signals(t.quotes, z_entry=1.5, window_ms=12 * HOUR, cooldown_ms=2 * HOUR)
    return found.select("row_no", "symbol", "ts", "side", F.round("price_cap", 6).alias("price_cap"), F.round("edge_bps", 3).alias("edge_bps"), F.round("z_score", 3).alias("z_score"))


def _impulse_sql(confirmed: bool) -> str:
    back = ", ".join(f"b{w} AS (SELECT q.row_no, s.mid AS back FROM q ASOF LEFT JOIN st s ON q.symbol = s.symbol AND q.venue = s.venue AND q.local_ts_ms - {w} >= s.ts)" for w in WINDOWS)
    cols = ", ".join(f"x{w}.back AS l{w}, y{w}.back AS g{w}" for w in WINDOWS)
    joins = " ".join(f"JOIN b{w} x{w} ON x{w}.row_no = p.a.row_no JOIN b{w} y{w} ON y{w}.row_no = p.b.row_no" for w in WINDOWS)
    tests = " UNION ALL ".join(
        f"SELECT row_no, symbol, ts, a, b, {k} AS o, {w} AS window_ms, 10000 * (a.mid - l{w}) / l{w} AS impulse, 10000 * (b.mid - g{w}) / g{w} AS moved, tr, dp FROM w WHERE l{w} IS NOT NULL AND g{w} IS NOT NULL" for k, w in enumerate(WINDOWS)
    )
    extra = f"AND ts - tr.ts <= window_ms AND tr.qty >= 2 AND tr.side = CASE WHEN impulse > 0 THEN 'buy' ELSE 'sell' END AND ts - dp.ts <= window_ms AND CASE WHEN impulse > 0 THEN dp.im >= -0.5 ELSE dp.im <= 0.5 END" if confirmed else ""
    return f"""WITH RECURSIVE {PAIRS}, st AS (SELECT symbol, venue, local_ts_ms AS ts, max_by(mid, row_no) AS mid FROM q GROUP BY ALL), {back},
 t1 AS (SELECT symbol, local_ts_ms AS ts, max_by({{'ts': local_ts_ms, 'side': side, 'qty': qty}}, row_no) AS tr FROM trades WHERE venue = 'binance' GROUP BY ALL),
 d0 AS (SELECT symbol, local_ts_ms, row_no, (sum(bid_qty) - sum(ask_qty)) / (sum(bid_qty) + sum(ask_qty)) AS im FROM depth_levels WHERE venue = 'binance' AND lvl <= 5 GROUP BY ALL),
 d1 AS (SELECT symbol, local_ts_ms AS ts, max_by({{'ts': local_ts_ms, 'im': im}}, row_no) AS dp FROM d0 GROUP BY ALL),
 w0 AS (SELECT p.row_no, p.symbol, p.local_ts_ms, greatest(p.a.ts, p.b.ts) AS ts, p.a, p.b, {cols} FROM p {joins}),
 w1 AS (SELECT w0.*, t1.tr FROM w0 ASOF LEFT JOIN t1 ON w0.symbol = t1.symbol AND w0.local_ts_ms >= t1.ts), w AS (SELECT w1.*, d1.dp FROM w1 ASOF LEFT JOIN d1 ON w1.symbol = d1.symbol AND w1.local_ts_ms >= d1.ts),
 c AS (SELECT *, impulse - moved AS lag_bps, row_number() OVER (PARTITION BY row_no ORDER BY o) AS first FROM ({tests}) WHERE abs(impulse) >= 20 AND abs(impulse - moved) - 2 > 0 AND ((impulse > 0 AND impulse - moved > 0) OR (impulse < 0 AND impulse - moved < 0)) {extra}),
 n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, row_no) AS j FROM c WHERE first = 1), {GREEDY}
 SELECT n.row_no, n.symbol, n.ts, CASE WHEN impulse > 0 THEN 'buy' ELSE 'sell' END AS side, window_ms, round(impulse, 4) AS impulse_bps, round(abs(lag_bps) - 2, 4) AS edge_bps, round(CASE WHEN impulse > 0 THEN b.ask ELSE b.bid END, 6) AS price_cap
 FROM n JOIN f ON n.symbol = f.symbol AND n.j = f.j WHERE f.kept"""


def _impulse_columns(found: DataFrame) -> DataFrame:
    return found.select("row_no", "symbol", "ts", "side", "window_ms", F.round("impulse_bps", 4).alias("impulse_bps"), F.round("edge_bps", 4).alias("edge_bps"), F.round("price_cap", 6).alias("price_cap"))


@query("impulse_signals", _impulse_sql(False), "quotes", "trades", "depth_levels")
def impulse_signals(t: Tables) -> DataFrame:
    return _impulse_columns(signals.impulse_signals(t.quotes, WINDOWS, 20.0, cooldown_ms=2 * HOUR))


@query("impulse_confirmation", _impulse_sql(True), "quotes", "trades", "depth_levels")
def impulse_confirmation(t: Tables) -> DataFrame:
    books = depth_snapshots(t.depth_levels).withColumn("imbalance", E.book_imbalance(5))
    return _impulse_columns(signals.impulse_signals(t.quotes, WINDOWS, 20.0, cooldown_ms=2 * HOUR, trades=t.trades, min_trade_qty=2.0, depth=books, min_imbalance=-0.5))


@query(
    "feature_snapshots",
    ewm_sql(12 * HOUR)
    + f""", rs AS (SELECT s.row_no, s.basis - coalesce(nullif(e.prior_mean, 0), 0) AS residual FROM s JOIN e ON s.symbol = e.symbol AND s.k = e.k), fq AS (SELECT *, (bid + ask) / 2 AS mid, lag((bid + ask) / 2) OVER (PARTITION BY symbol, venue ORDER BY {ORDER}) AS before FROM quotes), fp AS (SELECT *, last_value(CASE WHEN venue = 'binance' THEN {{'l': local_ts_ms, 'x': exchange_ts_ms, 'mid': mid, 'before': before}} END IGNORE NULLS) OVER w AS a,
 last_value(CASE WHEN venue = 'mexc' THEN {{'l': local_ts_ms, 'x': exchange_ts_ms, 'mid': mid, 'before': before, 'bid': bid, 'ask': ask}} END IGNORE NULLS) OVER w AS b FROM fq WINDOW w AS (PARTITION BY symbol ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT fp.row_no, round(residual, 3) AS residual_bps, round(10000 * (a.mid - a.before) / a.before, 4) AS impulse_bps, round(10000 * (b.ask - b.bid) / b.mid, 4) AS spread_bps, round(abs(10000 * (b.mid - b.before) / b.before), 4) AS volatility_bps,
 CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN abs(a.l - b.l) ELSE coalesce(a.l - a.x, b.l - b.x) END AS latency_ms FROM fp LEFT JOIN rs ON rs.row_no = fp.row_no""",
    "quotes",
)
def feature_snapshots(t: Tables) -> DataFrame:
    own = signals.feature_snapshots(t.quotes, residual_window_ms=12 * HOUR)
    return own.select("row_no", F.round("residual_bps", 3).alias("residual_bps"), *(F.round(c, 4).alias(c) for c in ("impulse_bps", "spread_bps", "volatility_bps")), "latency_ms")


_ALIGNED = f"""r AS (SELECT row_no, symbol, venue, ts, 10000 * (mid - pm) / pm AS ret FROM (SELECT row_no, symbol, venue, local_ts_ms AS ts, (bid + ask) / 2 AS mid, lag((bid + ask) / 2) OVER (PARTITION BY symbol, venue ORDER BY local_ts_ms, row_no) AS pm FROM quotes) WHERE pm > 0),
 g AS (SELECT * FROM (VALUES {", ".join(f"({i}, {x})" for i, x in enumerate(LAGS))}) AS v(lag_index, lag_ms)),
 j AS (SELECT l.symbol, l.venue AS direction, g.lag_index, g.lag_ms, l.ret AS x, o.ret AS y, row_number() OVER (PARTITION BY l.row_no, g.lag_index ORDER BY o.ts, o.row_no) AS k FROM r l CROSS JOIN g
 JOIN r o ON o.symbol = l.symbol AND o.venue <> l.venue AND o.ts - g.lag_ms BETWEEN l.ts - {HOUR // 2} AND l.ts + {HOUR // 2}),
 sc AS (SELECT symbol, direction, lag_index, lag_ms, count(*) AS pairs, coalesce(corr(x, y), 0) AS correlation, coalesce(count(*) FILTER (x <> 0 AND y <> 0 AND (x > 0) = (y > 0)) / nullif(count(*) FILTER (x <> 0 AND y <> 0), 0), 0) AS sign_agreement FROM j WHERE k = 1 GROUP BY ALL HAVING count(*) >= 5),
 s2 AS (SELECT *, 0.7 * greatest(0, correlation) + 0.3 * sign_agreement AS score FROM sc)"""


@query("leadership_scores", f"WITH {_ALIGNED} SELECT symbol, direction, lag_ms, pairs, round(correlation, 5) AS correlation, round(sign_agreement, 5) AS sign_agreement, round(score, 5) AS score FROM s2", "quotes")
def leadership_scores(t: Tables) -> DataFrame:
    return _rounded(leadlag.leadership_scores(t.quotes, LAGS, HOUR // 2).drop("lag_index"), ["correlation", "sign_agreement", "score"], 5)


@query(
    "leadership",
    f"""WITH {_ALIGNED}, b AS (SELECT symbol, direction, score, lag_ms, row_number() OVER (PARTITION BY symbol, direction ORDER BY score DESC, pairs DESC, lag_index) AS k FROM s2),
 c AS (SELECT y.symbol, p.score AS ps, p.lag_ms AS pl, q.score AS qs, q.lag_ms AS ql, p.score IS NOT NULL AND (q.score IS NULL OR p.score > q.score) AS first FROM (SELECT DISTINCT symbol FROM quotes) y LEFT JOIN (SELECT * FROM b WHERE k = 1 AND direction = 'binance') p USING (symbol) LEFT JOIN (SELECT * FROM b WHERE k = 1 AND direction = 'mexc') q USING (symbol)),
 d AS (SELECT symbol, first, CASE WHEN first THEN ps ELSE qs END AS s, CASE WHEN first THEN pl ELSE ql END AS l FROM c)
 SELECT symbol, CASE WHEN s >= 0.2 THEN CASE WHEN first THEN 'binance' ELSE 'mexc' END END AS leader, CASE WHEN s >= 0.2 THEN CASE WHEN first THEN 'mexc' ELSE 'binance' END END AS lagger, round(coalesce(s, 0), 5) AS leader_score, l AS lag_ms, CASE WHEN n < 2 THEN 'insufficient_samples' WHEN s IS NULL THEN 'insufficient_pairs' WHEN s >= 0.2 THEN 'ok' ELSE 'unstable' END AS reason, coalesce(s >= 0.2, false) AS stable FROM d JOIN (SELECT symbol, least(count(*) FILTER (venue = 'binance'), count(*) FILTER (venue = 'mexc')) AS n FROM quotes GROUP BY 1) USING (symbol)""",
    "quotes",
)
def leadership(t: Tables) -> DataFrame:
    return _rounded(leadlag.leadership(t.quotes, LAGS, HOUR // 2, min_score=0.2), ["leader_score"], 5)


def observations(t: Tables) -> DataFrame:
    """Lag observations from aligned returns: the leader's return predicts the lagger's."""
    pairs = leadlag.aligned_returns(leadlag.midpoint_returns(t.quotes), LAGS, HOUR // 2).where(F.col("direction") == E.LEADER)
    pnl = F.signum("x") * F.col("y") / 100
    return pairs.select("symbol", "lag_ms", F.col("x").alias("predicted_move_bps"), F.col("y").alias("actual_move_bps"), pnl.alias("paper_pnl_usd"))


_STATS = f"""{_ALIGNED}, st AS (SELECT symbol, lag_ms, count(*) AS samples, count(*) FILTER (sign(x) * sign(y) > 0) AS hits, count(*) FILTER (sign(x) * sign(y) > 0) / count(*) AS hit_rate, avg((y - x) * (y - x)) AS residual_variance, sum(sign(x) * y / 100) AS paper_pnl_usd
 FROM j WHERE k = 1 AND direction = 'binance' GROUP BY ALL)"""


@query("lag_candidate_stats", f"WITH {_STATS} SELECT symbol, lag_ms, samples, hits, round(hit_rate, 5) AS hit_rate, round(residual_variance, 2) AS residual_variance, round(paper_pnl_usd, 4) AS paper_pnl_usd FROM st", "quotes")
def lag_candidate_stats(t: Tables) -> DataFrame:
    own = leadlag.lag_candidate_stats(observations(t), LAGS)
    return own.select("symbol", "lag_ms", "samples", "hits", F.round("hit_rate", 5).alias("hit_rate"), F.round("residual_variance", 2).alias("residual_variance"), F.round("paper_pnl_usd", 4).alias("paper_pnl_usd"))


@query(
    "lag_selection",
    f"""WITH {_STATS}, z AS (SELECT *, samples >= 10 AS ok, 100 * hit_rate + paper_pnl_usd - residual_variance / 1000 AS score FROM st) SELECT symbol, CASE WHEN ok THEN lag_ms END AS lag_ms, CASE WHEN ok THEN 'ok' ELSE 'insufficient_samples' END AS reason, CASE WHEN ok THEN round(score, 3) END AS score
 FROM z QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ok DESC, score DESC, lag_ms) = 1""",
    "quotes",
)
def lag_selection(t: Tables) -> DataFrame:
    return _rounded(leadlag.lag_selection(leadlag.lag_candidate_stats(observations(t), LAGS), residual_penalty=0.001), ["score"], 3)


_FILL = """iq AS (SELECT i.*, z.q FROM intents i ASOF LEFT JOIN (SELECT symbol, local_ts_ms AS ts, max_by({'bid': bid, 'ask': ask, 'bs': bid_size, 'as_': ask_size}, row_no) AS q FROM quotes WHERE venue = 'mexc' GROUP BY ALL) z ON i.symbol = z.symbol AND i.created_ts_ms >= z.ts),
 v AS (SELECT *, CASE WHEN side = 'buy' THEN q.ask ELSE q.bid END AS px, CASE WHEN side = 'buy' THEN q.as_ ELSE q.bs END AS sz, CASE WHEN side = 'buy' THEN q.ask <= price_cap ELSE q.bid >= price_cap END AS touched FROM iq),
 fm AS (SELECT v.*, m.fill_model, CASE WHEN q IS NULL THEN 'no_quote' WHEN NOT touched THEN 'price_not_touched' WHEN m.fill_model = 'touch' THEN 'touch' WHEN m.fill_model = 'trade_through' THEN 'trade_required' WHEN greatest(0, coalesce(sz, 0)) >= qty THEN 'queue_available' WHEN sz IS NULL THEN 'queue_size_unknown' ELSE 'queue_not_available' END AS fill_reason
 FROM v CROSS JOIN (VALUES ('touch'), ('trade_through'), ('queue_aware')) AS m(fill_model)),
 fl AS (SELECT *, fill_reason IN ('touch', 'queue_available') AS filled FROM fm)"""


def _lagger_quotes(t: Tables) -> DataFrame:
    return t.quotes.where(F.col("venue") == E.LAGGER)


@query("fill_quote", f"WITH {_FILL} SELECT intent_id, filled, round(CASE WHEN filled THEN px END, 6) AS fill_price, CASE WHEN filled THEN qty ELSE 0 END AS fill_qty, fill_reason FROM fl WHERE fill_model = 'queue_aware'", "intents", "quotes")
def fill_quote(t: Tables) -> DataFrame:
    own = outcomes.fill_quote(outcomes.at_quote(t.intents, _lagger_quotes(t)), "queue_aware")
    return own.select("intent_id", "filled", F.round("fill_price", 6).alias("fill_price"), "fill_qty", "fill_reason")


@query("fill_model_variants", f"WITH {_FILL} SELECT fill_model, count(*) AS intents, count(*) FILTER (filled) AS fills, round(sum(CASE WHEN filled THEN qty * px ELSE 0 END), 4) AS notional FROM fl GROUP BY ALL", "intents", "quotes")
def fill_model_variants(t: Tables) -> DataFrame:
    own = outcomes.fill_model_variants(outcomes.at_quote(t.intents, _lagger_quotes(t)))
    return own.groupBy("fill_model").agg(F.count("*").alias("intents"), F.count_if("filled").alias("fills"), F.round(F.sum(F.coalesce(F.col("fill_qty") * F.col("fill_price"), F.lit(0.0))), 4).alias("notional"))


@query(
    "fill_model_diagnostics",
    f"WITH {_FILL} SELECT intent_id, symbol, count(DISTINCT filled) > 1 OR count(DISTINCT CASE WHEN filled THEN px END) > 1 AS has_difference, max(fill_reason) FILTER (fill_model = 'queue_aware') AS queue_reason, max(filled) FILTER (fill_model = 'touch') AS touch_filled FROM fl GROUP BY ALL",
    "intents", "quotes",
)
def fill_model_diagnostics(t: Tables) -> DataFrame:
    own = outcomes.fill_model_diagnostics(outcomes.fill_model_variants(outcomes.at_quote(t.intents, _lagger_quotes(t))))
    return own.select("intent_id", "symbol", "has_difference", F.col("models")["queue_aware"]["fill_reason"].alias("queue_reason"), F.col("models")["touch"]["filled"].alias("touch_filled"))


@query(
    "first_trade_through",
    f"""WITH h AS (SELECT i.intent_id, t.price, least(i.qty, t.qty) AS fq, t.local_ts_ms AS ts, t.row_no, row_number() OVER (PARTITION BY i.intent_id ORDER BY t.local_ts_ms, t.row_no) AS k FROM intents i JOIN trades t ON i.symbol = t.symbol AND t.local_ts_ms > i.created_ts_ms AND t.local_ts_ms <= i.created_ts_ms + {6 * HOUR}
 AND CASE WHEN i.side = 'buy' THEN t.price <= i.price_cap ELSE t.price >= i.price_cap END) SELECT i.intent_id, h.k IS NOT NULL AS filled, round(h.price, 6) AS fill_price, h.fq AS fill_qty, h.row_no AS trade_row FROM intents i LEFT JOIN h ON i.intent_id = h.intent_id AND h.k = 1""",
    "intents", "trades",
)
def first_trade_through(t: Tables) -> DataFrame:
    return outcomes.first_trade_through(t.intents, t.trades, 6 * HOUR).select("intent_id", "filled", F.round("fill_price", 6).alias("fill_price"), "fill_qty", "trade_row")


@query("pnl_values", "SELECT trade_id, round(gross, 6) AS gross_usd, round(cost, 6) AS cost_usd, round(gross - cost, 6) AS net_usd, round(10000 * gross / abs(e * 3), 6) AS pnl_bps FROM (SELECT trade_id, notional / 100 AS e, CASE WHEN trade_id % 2 = 0 THEN 1 ELSE -1 END * ((notional + gross_pnl_usd) / 100 - notional / 100) * 3 AS gross, (abs(notional / 100 * 3) + abs((notional + gross_pnl_usd) / 100 * 3)) * 4 / 10000 AS cost FROM closed_trades)", "closed_trades")
def pnl_values(t: Tables) -> DataFrame:
    own = t.closed_trades.select("trade_id", F.when(F.col("trade_id") % 2 == 0, "buy").otherwise("sell").alias("side"), (F.col("notional") / 100).alias("entry"), ((F.col("notional") + F.col("gross_pnl_usd")) / 100).alias("exit"), F.lit(3.0).alias("qty"))
    gross, cost, net, bps = E.pnl_values("side", "entry", "exit", "qty", 4.0)
    return own.select("trade_id", F.round(gross, 6).alias("gross_usd"), F.round(cost, 6).alias("cost_usd"), F.round(net, 6).alias("net_usd"), F.round(bps, 6).alias("pnl_bps"))


def _entries(t: Tables) -> DataFrame:
    """Touch fills of the intents; the residual ones with moments to exit by."""
    own = outcomes.fill_quote(outcomes.at_quote(t.intents, _lagger_quotes(t)), "touch").where("filled")
    return own.select(F.col("intent_id").alias("entry_id"), "intent_no", "symbol", "side", "qty", F.col("fill_price").alias("entry_price"), F.col("created_ts_ms").alias("entry_ts_ms"), "model", F.lit(0.0).alias("mean"), F.lit(30.0).alias("sigma"), F.lit(1.0).alias("beta"))


_EXITS = f"""{_FILL}, {PAIRS}, en AS (SELECT intent_id AS entry_id, intent_no, symbol, side, qty, px AS entry_price, created_ts_ms AS ets, model FROM fl WHERE fill_model = 'touch' AND filled),
 k AS (SELECT symbol, row_no, local_ts_ms AS ts, bid, ask, mid, a FROM p WHERE venue = 'mexc'),
 c AS (SELECT en.*, k.row_no, k.ts, k.bid, k.ask, k.a, 10000 * (ln(k.mid) - ln(k.a.mid)) / 30 AS z, CASE WHEN side = 'buy' THEN k.bid ELSE k.ask END AS xp FROM en JOIN k ON en.symbol = k.symbol AND k.ts > en.ets),
 d AS (SELECT *, CASE WHEN a IS NULL OR ts - a.ts > {3 * HOUR} THEN 'stale_data_stop' WHEN model = 'residual_zscore' AND CASE WHEN side = 'buy' THEN z >= -0.4 ELSE z <= 0.4 END THEN 'zscore_mean_reversion'
 WHEN model = 'residual_zscore' AND CASE WHEN side = 'buy' THEN z <= -4 ELSE z >= 4 END THEN 'adverse_move_stop' WHEN 10000 * CASE WHEN side = 'buy' THEN xp - entry_price ELSE entry_price - xp END / entry_price >= 40 THEN 'take_profit' WHEN ts >= ets + {6 * HOUR} THEN 'ttl_exit' END AS reason FROM c),
 x AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY ts, row_no) AS o FROM d WHERE reason IS NOT NULL)"""


@query(
    "label_exits",
    f"WITH {_EXITS} SELECT en.entry_id, x.reason AS exit_reason, x.row_no AS exit_row, x.ts AS exit_ts_ms, round(CASE WHEN en.side = 'buy' THEN x.xp - en.entry_price ELSE en.entry_price - x.xp END * en.qty - (en.entry_price + x.xp) * en.qty * 4 / 10000, 6) AS realized_pnl_usd FROM en LEFT JOIN x ON en.entry_id = x.entry_id AND x.o = 1",
    "intents", "quotes",
)
def label_exits(t: Tables) -> DataFrame:
    own = outcomes.label_exits(_entries(t), t.quotes, 6 * HOUR, 40.0, 3 * HOUR, cost_bps=4.0)
    return own.select("entry_id", "exit_reason", "exit_row", "exit_ts_ms", F.round("realized_pnl_usd", 6).alias("realized_pnl_usd"))


@query("residual_exit_z", f"WITH {PAIRS} SELECT row_no, round(10000 * (ln(mid) - 0.9 * ln(a.mid)) / 30 - 1, 5) AS z FROM p WHERE venue = 'mexc' AND a IS NOT NULL", "quotes")
def residual_exit_z(t: Tables) -> DataFrame:
    from tickloom.operators.asof import latest_pair

    pairs = latest_pair(t.quotes.withColumn("mid", E.mid()), E.LEADER, E.LAGGER, E.event_order(), ["mid"]).where((F.col("venue") == E.LAGGER) & F.col("leader").isNotNull())
    own = pairs.select("row_no", E.mid().alias("mid"), F.col("leader.mid").alias("leader_mid"), F.lit("residual_zscore").alias("model"), F.lit(30.0).alias("mean"), F.lit(30.0).alias("sigma"), F.lit(0.9).alias("beta"))
    return own.select("row_no", F.round(outcomes.residual_exit_z(), 5).alias("z"))


@query(
    "label_reversals",
    f"""WITH {_FILL}, en AS (SELECT intent_id AS entry_id, symbol, side, created_ts_ms AS ets FROM fl WHERE fill_model = 'touch' AND filled),
 r AS (SELECT en.*, i.intent_id AS reversed_by, i.created_ts_ms AS rts, row_number() OVER (PARTITION BY en.entry_id ORDER BY i.created_ts_ms, i.intent_no) AS k FROM en JOIN intents i ON i.symbol = en.symbol AND i.side <> en.side AND i.created_ts_ms > en.ets),
 lq AS (SELECT symbol, local_ts_ms AS ts, max_by({{'bid': bid, 'ask': ask}}, row_no) AS q FROM quotes WHERE venue = 'mexc' GROUP BY ALL)
 SELECT r.entry_id, r.reversed_by, round(CASE WHEN r.side = 'buy' THEN lq.q.bid ELSE lq.q.ask END, 6) AS exit_price FROM (SELECT * FROM r WHERE k = 1) r ASOF LEFT JOIN lq ON r.symbol = lq.symbol AND r.rts >= lq.ts""",
    "intents", "quotes",
)
def label_reversals(t: Tables) -> DataFrame:
    return outcomes.label_reversals(_entries(t), t.intents, _lagger_quotes(t)).select("entry_id", "reversed_by", F.round("exit_price", 6).alias("exit_price"))


@query(
    "mark_to_market",
    f"""WITH {_FILL}, en AS (SELECT symbol, side, qty, px AS e FROM fl WHERE fill_model = 'touch' AND filled), l AS (SELECT symbol, max_by({{'bid': bid, 'ask': ask}}, (local_ts_ms, row_no)) AS q FROM quotes WHERE venue = 'mexc' GROUP BY ALL),
 m AS (SELECT en.*, CASE WHEN side = 'buy' THEN q.bid ELSE q.ask END AS x FROM en JOIN l USING (symbol)), g AS (SELECT symbol, CASE WHEN side = 'buy' THEN x - e ELSE e - x END * qty AS gross, (e + x) * qty * 4 / 10000 AS cost FROM m)
 SELECT symbol, round(sum(gross), 4) AS gross_usd, round(sum(cost), 4) AS cost_usd, round(sum(gross - cost), 4) AS net_usd FROM g GROUP BY ALL""",
    "intents", "quotes",
)
def mark_to_market(t: Tables) -> DataFrame:
    own = outcomes.mark_to_market(_entries(t), _lagger_quotes(t), 4.0)
    return _rounded(own, ["gross_usd", "cost_usd", "net_usd"])


@query(
    "exposure_timeline",
    """WITH m AS (SELECT trade_id, symbol, CASE WHEN trade_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CAST(notional AS DECIMAL(18,2)) AS notional, CAST(0 AS DECIMAL(18,4)) AS pnl, entry_ts_ms AS ts, 1 AS c FROM closed_trades UNION ALL SELECT trade_id, symbol, CASE WHEN trade_id % 2 = 0 THEN 'buy' ELSE 'sell' END, CAST(notional AS DECIMAL(18,2)), CAST(gross_pnl_usd AS DECIMAL(18,4)), exit_ts_ms, -1 FROM closed_trades)
 SELECT trade_id AS position_id, c AS change, CAST(sum(c) OVER w AS BIGINT) AS open_positions, CAST(sum(c * notional) OVER w AS DOUBLE) AS total_notional, CAST(sum(pnl) OVER w AS DOUBLE) AS realized_pnl, CAST(sum(c * notional) OVER v AS DOUBLE) AS symbol_notional, CAST(sum(CASE WHEN side = 'buy' THEN c ELSE 0 END) OVER v AS BIGINT) AS long_count
 FROM m WINDOW w AS (ORDER BY ts, c, trade_id ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY symbol ORDER BY ts, c, trade_id ROWS UNBOUNDED PRECEDING)""",
    "closed_trades",
)
def exposure_timeline(t: Tables) -> DataFrame:
    fills = t.closed_trades.select(F.col("trade_id").alias("position_id"), "symbol", F.when(F.col("trade_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("notional").cast("decimal(18,2)").alias("notional"), "entry_ts_ms", "exit_ts_ms", F.col("gross_pnl_usd").cast("decimal(18,4)").alias("realized_pnl_usd"))
    own = outcomes.exposure_timeline(fills)
    return own.select("position_id", "change", "open_positions", *(F.col(c).cast("double").alias(c) for c in ("total_notional", "realized_pnl", "symbol_notional")), "long_count")
