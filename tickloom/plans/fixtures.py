"""Market-data views over the test tables, as one SQL text for Spark and for the checking engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: View name to SQL. {name} is another view or a table; MS(x) is epoch milliseconds.
VIEWS = {
    "ticks": """SELECT event_id AS row_no, event_type AS raw_type, MS(ts) AS local_ts_ms, MS(ts) - (event_id % 7) * 10 AS exchange_ts_ms,
 CASE WHEN event_id % 2 = 0 THEN 'binance' ELSE 'mexc' END AS venue, CONCAT('S', CAST(user_id % 8 AS STRING), 'USDT') AS symbol,
 CAST(100 AS DOUBLE) + value / CAST(100 AS DOUBLE) AS mid, CAST(event_id % 5 + 1 AS DOUBLE) / CAST(100 AS DOUBLE) AS half_spread,
 CAST(event_id % 11 AS DOUBLE) AS size_a, CAST(event_id % 13 AS DOUBLE) AS size_b FROM {events}""",
    "quotes": """SELECT row_no, local_ts_ms, exchange_ts_ms, venue, symbol, mid - half_spread AS bid, mid + half_spread AS ask,
 CASE WHEN row_no % 17 = 0 THEN NULL ELSE size_a END AS bid_size, CASE WHEN row_no % 17 = 0 THEN NULL ELSE size_b END AS ask_size
 FROM {ticks} WHERE raw_type IN ('click','view','signup')""",
    "trades": """SELECT row_no, local_ts_ms, exchange_ts_ms, venue, symbol, mid AS price, size_a + 1 AS qty,
 CASE WHEN row_no % 3 = 0 THEN NULL WHEN row_no % 3 = 1 THEN 'buy' ELSE 'sell' END AS side FROM {ticks} WHERE raw_type = 'purchase'""",
    "depth_levels": """SELECT row_no, local_ts_ms, venue, symbol, lvl, mid - half_spread * lvl AS bid_price, size_a + lvl AS bid_qty,
 mid + half_spread * lvl AS ask_price, size_b + lvl AS ask_qty FROM {ticks} CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6)) AS l(lvl) WHERE raw_type = 'error'""",
    "trade_lines": """SELECT l_orderkey, l_linenumber, MAX(l_suppkey) AS suppkey, MAX(l_quantity) AS qty, MAX(l_extendedprice) AS notional,
 MAX(l_discount) AS discount, MAX(l_tax) AS tax, MAX(l_returnflag) AS flag, MAX(MS(l_shipdate)) AS ship_ts_ms FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "order_updates": """SELECT l_orderkey * 10 + l_linenumber AS row_no, CONCAT('llb-', CAST(l_orderkey AS STRING)) AS client_order_id,
 CASE WHEN flag = 'R' AND l_linenumber % 3 = 0 THEN 'cancelled' WHEN l_linenumber = 1 THEN 'accepted' ELSE 'fill' END AS event_type,
 qty AS filled_qty, notional / qty AS avg_fill_price, ship_ts_ms AS ts_ms FROM {trade_lines}""",
    "open_orders": """SELECT CONCAT('llb-', CAST(o_orderkey AS STRING)) AS client_order_id, CONCAT('S', CAST(o_custkey % 8 AS STRING), 'USDT') AS symbol,
 CAST(20 + o_orderkey % 40 AS DOUBLE) AS qty, 'accepted' AS status, MS(o_orderdate) AS accepted_ts_ms, MS(o_orderdate) + 5184000000 AS expires_ts_ms
 FROM {orders} WHERE o_orderkey % 11 <> 0""",
    "closed_trades": """SELECT l_orderkey * 10 + l_linenumber AS trade_id, CONCAT('S', CAST(suppkey % 8 AS STRING), 'USDT') AS symbol,
 CASE WHEN flag = 'A' THEN 'impulse_transfer' ELSE 'residual_zscore' END AS model,
 CASE l_linenumber % 4 WHEN 0 THEN 'take_profit' WHEN 1 THEN 'ttl_exit' WHEN 2 THEN 'zscore_mean_reversion' ELSE 'stale_data_stop' END AS exit_reason,
 notional, notional * (discount - CAST(5 AS DOUBLE) / CAST(100 AS DOUBLE)) AS gross_pnl_usd, tax * CAST(100 AS DOUBLE) AS slippage_bps,
 CASE WHEN qty > 45 THEN NULL ELSE qty - 25 END AS impulse_bps, ship_ts_ms - (l_orderkey % 1000) * 1000 AS entry_ts_ms, ship_ts_ms AS exit_ts_ms FROM {trade_lines}""",
    "paper_fills": """SELECT CONCAT('llb-', CAST(o_orderkey AS STRING)) AS client_order_id, CAST(o_orderkey % 7 + 1 AS DOUBLE) AS qty, o_totalprice AS price
 FROM {orders} WHERE o_orderkey % 10 <> 0""",
    "demo_fills": """SELECT CONCAT('llb-', CAST(o_orderkey AS STRING)) AS client_order_id, CAST((o_orderkey + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) % 7 + 1 AS DOUBLE) AS qty,
 o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0 END AS price FROM {orders} WHERE o_orderkey % 10 <> 1""",
    "raw_messages": """SELECT row_no, local_ts_ms, venue, CASE WHEN venue = 'binance'
 THEN CONCAT('{{"data":{{"s":"', LOWER(symbol), '","b":"', CAST(CAST(FLOOR(bid * 100) AS BIGINT) AS STRING), '","a":"', CAST(CAST(FLOOR(ask * 100) AS BIGINT) AS STRING), '","T":', CAST(exchange_ts_ms AS STRING), '}}}}')
 ELSE CONCAT('{{"channel":"push.ticker","data":{{"symbol":"', REPLACE(symbol, 'USDT', '_USDT'), '","bid1":"', CAST(CAST(FLOOR(bid * 100) AS BIGINT) AS STRING), '","ask1":"', CAST(CAST(FLOOR(ask * 100) AS BIGINT) AS STRING), '","timestamp":', CAST(exchange_ts_ms AS STRING), '}}}}')
 END AS body FROM {quotes}""",
    "universe": """SELECT CONCAT('P', CAST(p_partkey AS STRING), 'USDT') AS symbol, p_partkey % 19 <> 0 AS leader_enabled, p_partkey % 23 <> 0 AS lagger_enabled,
 p_retailprice * 40000 AS leader_volume, p_retailprice * CAST(p_partkey % 97 + 1 AS DOUBLE) * 100 AS lagger_volume,
 p_retailprice * 900 AS leader_depth, p_retailprice * CAST(p_size AS DOUBLE) AS lagger_depth, CAST(p_partkey % 15 AS DOUBLE) AS spread_bps,
 CAST(p_partkey % 6 AS DOUBLE) AS tick_bps FROM {part}""",
    # entries and a day of audit records that several reports read
    "intents": """SELECT row_no AS intent_no, CONCAT('m', CAST(row_no % 2 AS STRING), '-', symbol, '-', CAST(local_ts_ms AS STRING), '-', CAST(row_no AS STRING)) AS intent_id, symbol, local_ts_ms AS created_ts_ms,
 CASE WHEN row_no % 3 = 0 THEN 'sell' ELSE 'buy' END AS side, CAST(row_no % 4 + 1 AS DOUBLE) AS qty, price + CAST(row_no % 5 - 2 AS DOUBLE) AS price_cap,
 CAST(row_no % 9 - 1 AS DOUBLE) AS expected_edge_bps, CASE WHEN row_no % 2 = 0 THEN 'impulse_transfer' ELSE 'residual_zscore' END AS model FROM {trades}""",
    "audit": """SELECT trade_id AS row_no, symbol, model, exit_ts_ms AS timestamp_ms,
 CASE WHEN trade_id % 3 = 0 THEN 'replay_position_exit' ELSE 'replay_signal_decision' END AS event_type,
 CASE WHEN trade_id % 3 = 0 THEN 'closed' WHEN trade_id % 7 = 0 THEN 'risk_blocked' WHEN trade_id % 5 = 0 THEN 'not_filled' ELSE 'filled' END AS decision_result,
 trade_id % 3 = 0 OR trade_id % 7 <> 0 AS risk_allowed, CASE WHEN trade_id % 3 <> 0 AND trade_id % 7 = 0 THEN NULL ELSE trade_id % 3 = 0 OR trade_id % 5 <> 0 END AS fill_filled,
 CONCAT('i-', CAST(trade_id AS STRING)) AS intent_id, CASE WHEN trade_id % 3 = 0 THEN exit_reason END AS exit_reason,
 CASE WHEN trade_id % 3 = 0 THEN gross_pnl_usd END AS gross_pnl_usd, CASE WHEN trade_id % 3 = 0 THEN notional * 2 * slippage_bps / CAST(10000 AS DOUBLE) END AS cost_usd,
 CASE WHEN trade_id % 3 = 0 THEN gross_pnl_usd - notional * 2 * slippage_bps / CAST(10000 AS DOUBLE) END AS realized_pnl_usd,
 slippage_bps, impulse_bps, entry_ts_ms, notional FROM {closed_trades}""",
}

_NAMES = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")
_MS = re.compile(r"MS\((\w+)\)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a lazy DataFrame; nothing is registered in the session."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    text = _MS.sub(r"unix_millis(CAST(\1 AS TIMESTAMP))", VIEWS[name])
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in dict.fromkeys(_NAMES.findall(text))})


def _needed(name: str, found: list[str]) -> None:
    for n in dict.fromkeys(_NAMES.findall(VIEWS[name])):
        if n in VIEWS:
            _needed(n, found)
    if name not in found:
        found.append(name)


def duck(sql: str, *names: str) -> str:
    """DuckDB SQL: the views that are named as common table expressions before sql, which may begin with WITH."""
    found: list[str] = []
    for name in names:
        _needed(name, found)
    parts = []
    for name in found:
        text = _MS.sub(r"(epoch_us(CAST(\1 AS TIMESTAMP)) // 1000)", VIEWS[name])
        parts.append(f"{name} AS ({_NAMES.sub(r'\1', text).replace('{{', '{').replace('}}', '}').replace('AS STRING', 'AS VARCHAR')})")
    body = sql.strip()
    head = "WITH "
    if body[:15].upper() == "WITH RECURSIVE ":
        head, body = "WITH RECURSIVE ", body[15:]
    elif body[:5].upper() == "WITH ":
        body = body[5:]
    else:
        return f"{head}{', '.join(parts)} {body}" if parts else body
    return head + ", ".join([*parts, body])
