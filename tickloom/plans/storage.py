"""Queries that write tables and read them back, and normalise raw messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.plans.market import depth_snapshots
from tickloom.plans.registry import Tables, query
from tickloom.sources import events as ev
from tickloom.sources import store


def _events(t: Tables) -> DataFrame:
    return ev.events_from_typed(t.quotes, t.trades, depth_snapshots(t.depth_levels))


def _quote_columns(df: DataFrame) -> DataFrame:
    return df.select("row_no", "local_ts_ms", "venue", "symbol", F.round("bid", 6).alias("bid"), F.round("ask", 6).alias("ask"), "bid_size")


_QUOTES = "SELECT row_no, local_ts_ms, venue, symbol, round(bid, 6) AS bid, round(ask, 6) AS ask, bid_size FROM quotes"


@query("append_events_jsonl", "SELECT 'book_ticker' AS event_type, row_no, venue, symbol, local_ts_ms FROM quotes UNION ALL SELECT 'trade', row_no, venue, symbol, local_ts_ms FROM trades UNION ALL SELECT 'orderbook_depth', row_no, venue, symbol, local_ts_ms FROM depth_levels WHERE lvl = 1", "quotes", "trades", "depth_levels")
def append_events_jsonl(t: Tables) -> DataFrame:
    path = store.scratch(t.spark, "events-jsonl")
    own = _events(t)
    ev.append_events_jsonl(own.where("event_type = 'book_ticker'"), path)
    ev.append_events_jsonl(own.where("event_type <> 'book_ticker'"), path)
    return ev.read_events_jsonl(t.spark, path).select("event_type", "row_no", "venue", "symbol", "local_ts_ms")


@query("read_events_jsonl", _QUOTES, "quotes")
def read_events_jsonl(t: Tables) -> DataFrame:
    path = store.scratch(t.spark, "events-jsonl")
    ev.append_events_jsonl(ev.events_from_typed(t.quotes), path)
    return _quote_columns(ev.quotes_from_events(ev.read_events_jsonl(t.spark, [path])))


@query("write_events_parquet", "SELECT strftime(make_timestamp(local_ts_ms * 1000), '%Y-%m-%d') AS day, venue, row_no, symbol, exchange_ts_ms, round(bid, 6) AS bid FROM quotes", "quotes")
def write_events_parquet(t: Tables) -> DataFrame:
    path = store.scratch(t.spark, "events")
    ev.write_events_parquet(ev.events_from_typed(t.quotes), path)
    return t.spark.read.parquet(path).select(F.col("day").cast("string").alias("day"), "venue", "row_no", "symbol", "exchange_ts_ms", F.round(F.col("bid_price").cast("double"), 6).alias("bid"))


@query("read_events_parquet", _QUOTES, "quotes")
def read_events_parquet(t: Tables) -> DataFrame:
    path = store.scratch(t.spark, "events")
    ev.write_events_parquet(ev.events_from_typed(t.quotes), path)
    return _quote_columns(ev.quotes_from_events(ev.read_events_parquet(t.spark, path)))


@query("convert_jsonl_to_parquet", "SELECT *, (SELECT count(*) FROM quotes) + (SELECT count(*) FROM trades) AS converted FROM (SELECT 'book_ticker' AS event_type, row_no, symbol, local_ts_ms FROM quotes UNION ALL SELECT 'trade', row_no, symbol, local_ts_ms FROM trades)", "quotes", "trades")
def convert_jsonl_to_parquet(t: Tables) -> DataFrame:
    source, target = store.scratch(t.spark, "events-jsonl"), store.scratch(t.spark, "events")
    ev.append_events_jsonl(ev.events_from_typed(t.quotes, t.trades), source)
    n = ev.convert_jsonl_to_parquet(t.spark, source, target)
    return t.spark.read.parquet(target).select("event_type", "row_no", "symbol", "local_ts_ms", F.lit(n).cast("long").alias("converted"))


@query("write_audit_jsonl", "SELECT row_no, symbol, CAST(gross_pnl_usd AS DOUBLE) AS gross_pnl_usd, risk_allowed FROM audit", "audit")
def write_audit_jsonl(t: Tables) -> DataFrame:
    path = store.scratch(t.spark, "audit")
    ev.write_audit_jsonl(t.audit, path)
    own = t.spark.read.schema("row_no long, symbol string, gross_pnl_usd string, risk_allowed boolean").json(path)
    return own.withColumn("gross_pnl_usd", F.col("gross_pnl_usd").cast("double"))


@query("quotes_from_events", _QUOTES, "quotes")
def quotes_from_events(t: Tables) -> DataFrame:
    return _quote_columns(ev.quotes_from_events(_events(t)))


@query("trades_from_events", "SELECT row_no, venue, symbol, round(price, 6) AS price, qty, side FROM trades", "trades")
def trades_from_events(t: Tables) -> DataFrame:
    return ev.trades_from_events(_events(t)).select("row_no", "venue", "symbol", F.round("price", 6).alias("price"), "qty", "side")


@query("depth_from_events", "SELECT row_no, symbol, count(*) AS levels, round(max(bid_price), 6) AS best_bid, max(CASE WHEN lvl = 1 THEN ask_qty END) AS best_ask_qty FROM depth_levels GROUP BY ALL", "depth_levels")
def depth_from_events(t: Tables) -> DataFrame:
    return ev.depth_from_events(_events(t)).select("row_no", "symbol", F.size("bids").cast("long").alias("levels"), F.round(F.col("bids")[0]["price"], 6).alias("best_bid"), F.col("asks")[0]["qty"].alias("best_ask_qty"))


@query("events_from_typed", "SELECT row_no, 'book_ticker' AS event_type, symbol FROM quotes UNION ALL SELECT row_no, 'trade', symbol FROM trades UNION ALL SELECT row_no, 'orderbook_depth', symbol FROM depth_levels WHERE lvl = 1", "quotes", "trades", "depth_levels")
def events_from_typed(t: Tables) -> DataFrame:
    return _events(t).select("row_no", "event_type", "symbol")


@query("normalize_quote_messages", "SELECT row_no, venue, CASE WHEN venue = 'mexc' THEN replace(symbol, 'USDT', '_USDT') ELSE symbol END AS symbol, CAST(floor(bid * 100) AS DOUBLE) AS bid, CAST(floor(ask * 100) AS DOUBLE) AS ask, exchange_ts_ms FROM quotes", "quotes")
def normalize_quote_messages(t: Tables) -> DataFrame:
    return ev.normalize_quote_messages(t.raw_messages).select("row_no", "venue", "symbol", "bid", "ask", "exchange_ts_ms")


@query("normalize_trade_messages", "SELECT row_no, symbol, round(price, 6) AS price, qty, side FROM trades WHERE row_no % 5 <> 0", "trades")
def normalize_trade_messages(t: Tables) -> DataFrame:
    kind = F.when(F.col("row_no") % 5 == 0, "kline").when(F.col("row_no") % 2 == 0, "aggTrade").otherwise("trade")
    body = F.to_json(F.struct(F.struct(kind.alias("e"), F.lower("symbol").alias("s"), F.col("price").cast("string").alias("p"), F.col("qty").cast("string").alias("q"), (F.col("side") == "sell").alias("m"), F.col("exchange_ts_ms").alias("T")).alias("data")))
    raw = t.trades.select("row_no", "venue", "local_ts_ms", body.alias("body"))
    return ev.normalize_trade_messages(raw).select("row_no", "symbol", F.round("price", 6).alias("price"), "qty", "side")


@query("normalize_depth_messages", "SELECT row_no, CASE WHEN venue = 'mexc' THEN replace(symbol, 'USDT', '_USDT') ELSE symbol END AS symbol, count(*) AS bid_levels, round(max(bid_price), 6) AS best_bid, row_no AS version FROM depth_levels GROUP BY row_no, venue, symbol", "depth_levels")
def normalize_depth_messages(t: Tables) -> DataFrame:
    pair = lambda c: F.concat(F.transform(c, lambda x: F.array(x["price"].cast("string"), x["qty"].cast("string"))), F.array(F.array(F.lit("1"))))
    book = depth_snapshots(t.depth_levels)
    lead = F.to_json(F.struct(F.struct(F.lit("depthUpdate").alias("e"), F.col("symbol").alias("s"), pair("bids").alias("b"), pair("asks").alias("a"), F.col("row_no").alias("u")).alias("data")))
    lag = F.to_json(F.struct(F.col("symbol").alias("symbol"), F.struct(pair("bids").alias("bids"), pair("asks").alias("asks"), F.col("row_no").alias("version")).alias("data")))
    raw = book.select("row_no", "venue", "local_ts_ms", F.when(F.col("venue") == "mexc", lag).otherwise(lead).alias("body"))
    return ev.normalize_depth_messages(raw).select("row_no", "symbol", F.size("bids").cast("long").alias("bid_levels"), F.round(F.col("bids")[0]["price"], 6).alias("best_bid"), "version")


def _raw_info(t: Tables) -> DataFrame:
    n = F.expr("try_cast(regexp_extract(symbol, '([0-9]+)', 1) AS BIGINT)")
    u = t.universe.withColumn("n", n)
    rules = F.array(F.create_map(F.lit("filterType"), F.lit("PRICE_FILTER"), F.lit("tickSize"), (F.col("tick_bps") / 100).cast("string")), F.create_map(F.lit("filterType"), F.lit("LOT_SIZE"), F.lit("stepSize"), F.lit("0.5"), F.lit("minQty"), F.lit("1")), F.create_map(F.lit("filterType"), F.lit("MIN_NOTIONAL"), F.lit("notional"), F.lit("5")))
    lead = F.to_json(F.struct(F.lower("symbol").alias("symbol"), F.when(F.col("leader_enabled"), "TRADING").otherwise("BREAK").alias("status"), F.lit("PERPETUAL").alias("contractType"), F.when(F.col("n") % 13 == 0, "BUSD").otherwise("USDT").alias("quoteAsset"), rules.alias("filters")))
    lag = F.to_json(F.struct(F.col("symbol"), F.when(F.col("lagger_enabled"), 0).otherwise(1).alias("state"), (F.col("tick_bps") / 100).alias("priceUnit"), F.lit(1).alias("volUnit"), F.lit(1).alias("minVol"), F.lit(0.0002).alias("makerFeeRate"), (F.col("n") % 17 != 0).alias("apiAllowed")))
    row = lambda venue, body: u.select(F.lit(venue).alias("venue"), F.lit("usdt_perp").alias("market"), body.alias("body"))
    return row("binance", lead).unionByName(row("mexc", lag))


@query(
    "normalize_symbol_info",
    """WITH n AS (SELECT *, CAST(regexp_extract(symbol, '([0-9]+)', 1) AS BIGINT) AS n FROM universe) SELECT 'binance' AS venue, symbol, leader_enabled AND n % 13 <> 0 AS trading_enabled, true AS api_allowed, tick_bps / 100 AS price_tick, CAST(0.5 AS DOUBLE) AS qty_step, CAST(5 AS DOUBLE) AS min_notional FROM n
 UNION ALL SELECT 'mexc', symbol, lagger_enabled, n % 17 <> 0, tick_bps / 100, CAST(1 AS DOUBLE), NULL FROM n""",
    "universe",
)
def normalize_symbol_info(t: Tables) -> DataFrame:
    return ev.normalize_symbol_info(_raw_info(t)).select("venue", "symbol", "trading_enabled", "api_allowed", "price_tick", "qty_step", "min_notional")


@query("normalize_stats_24h", "SELECT 'binance' AS venue, symbol, round(leader_volume, 2) AS quote_volume FROM universe UNION ALL SELECT 'mexc', symbol, CASE WHEN spread_bps = 0 THEN 0 ELSE round(lagger_volume, 2) END FROM universe", "universe")
def normalize_stats_24h(t: Tables) -> DataFrame:
    u = t.universe
    lead = u.select(F.lit("binance").alias("venue"), F.lit("spot").alias("market"), F.to_json(F.struct("symbol", F.col("leader_volume").cast("string").alias("quoteVolume"))).alias("body"))
    lag = u.select(F.lit("mexc").alias("venue"), F.lit("usdt_perp").alias("market"), F.to_json(F.struct("symbol", F.when(F.col("spread_bps") != 0, F.col("lagger_volume")).alias("amount24"))).alias("body"))
    return ev.normalize_stats_24h(lead.unionByName(lag)).select("venue", "symbol", F.round("quote_volume", 2).alias("quote_volume"))


@query("normalize_book_snapshots", "SELECT row_no, upper(symbol) AS symbol, CASE WHEN row_no % 17 = 0 THEN 0 ELSE round(bid, 6) END AS bid, round(ask, 6) AS ask FROM quotes", "quotes")
def normalize_book_snapshots(t: Tables) -> DataFrame:
    price = F.when(F.col("row_no") % 17 != 0, F.col("bid").cast("string"))
    lead = F.to_json(F.struct(F.lower("symbol").alias("symbol"), price.alias("bidPrice"), F.col("ask").cast("string").alias("askPrice"), F.col("row_no").alias("time")))
    lag = F.to_json(F.struct("symbol", price.alias("bid1"), F.col("ask").alias("ask1"), F.col("row_no").alias("timestamp")))
    raw = t.quotes.select("venue", F.lit("usdt_perp").alias("market"), F.when(F.col("venue") == "mexc", lag).otherwise(lead).alias("body"))
    return ev.normalize_book_snapshots(raw).select(F.col("ts_ms").alias("row_no"), "symbol", F.round("bid", 6).alias("bid"), F.round("ask", 6).alias("ask"))


@query("report_history", "SELECT symbol || '.json' AS file, CAST(max(local_ts_ms % 1000) AS DOUBLE) AS max_feed_gap_ms, CAST(count(*) AS DOUBLE) AS intents, CASE symbol WHEN 'S0USDT' THEN 0 WHEN 'S1USDT' THEN CAST(0.5 AS DOUBLE) ELSE 1 END AS health FROM quotes GROUP BY symbol", "quotes")
def report_history(t: Tables) -> DataFrame:
    path = store.scratch(t.spark, "reports")
    status = F.when(F.col("symbol") == "S0USDT", "critical").when(F.col("symbol") == "S1USDT", "warn").otherwise("ok")
    own = t.quotes.groupBy("symbol").agg(F.max(F.col("local_ts_ms") % 1000).alias("gap"), F.count("*").alias("n"))
    body = F.to_json(F.struct(F.struct(status.alias("status")).alias("system"), F.struct(F.create_map(F.lit("binance:x"), F.struct(F.col("gap").alias("max_gap_ms"))).alias("streams")).alias("feed_health"), F.struct(F.col("n").alias("intents")).alias("paper_summary")))
    own.select(F.col("symbol").alias("name"), body.alias("value")).repartition("name").write.partitionBy("name").text(path)
    found = ev.report_history(t.spark, path)
    files = t.spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.concat("name", F.lit(".json")).alias("label"))
    return found.join(files, "file").select(F.col("label").alias("file"), "max_feed_gap_ms", "intents", "health")


def _rows(tables: dict[str, DataFrame], *columns: Column | str, **by_table: Column) -> DataFrame:
    """The named tables as one, with one column, `what`, that differs."""
    return reduce(DataFrame.unionByName, (tables[n].select(F.lit(n).alias("table_name"), *columns, c.cast("string").alias("what")) for n, c in by_table.items()))


@query("ingest_market_facts", "SELECT 'market_quotes' AS table_name, row_no, venue, symbol, local_ts_ms, 'book_ticker' AS what FROM quotes UNION ALL SELECT 'market_quotes', row_no, venue, symbol, local_ts_ms, 'orderbook_depth' FROM depth_levels WHERE lvl = 1 UNION ALL SELECT 'market_trades', row_no, venue, symbol, local_ts_ms, 'trade' FROM trades", "quotes", "trades", "depth_levels")
def ingest_market_facts(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return _rows(store.ingest_market_facts(_events(t), "day-1"), "row_no", "venue", "symbol", "local_ts_ms", market_quotes=kind, market_trades=kind)


@query(
    "ingest_audit_facts",
    "SELECT 'fill_facts' AS table_name, row_no, intent_id, symbol, CAST(fill_filled AS VARCHAR) AS what FROM audit WHERE fill_filled IS NOT NULL UNION ALL SELECT 'order_facts', row_no, intent_id, symbol, decision_result FROM audit WHERE event_type = 'replay_signal_decision' UNION ALL SELECT 'pnl_facts', row_no, intent_id, symbol, exit_reason FROM audit WHERE event_type = 'replay_position_exit' UNION ALL SELECT 'signal_intents', row_no, intent_id, symbol, model FROM audit WHERE event_type = 'replay_signal_decision'",
    "audit",
)
def ingest_audit_facts(t: Tables) -> DataFrame:
    c = F.col
    return _rows(store.ingest_audit_facts(t.audit, "run-1"), "row_no", "intent_id", "symbol", fill_facts=c("fill_filled"), order_facts=c("decision_result"), pnl_facts=c("exit_reason"), signal_intents=c("model"))


@query("table_counts", "SELECT 'quotes' AS table_name, count(*) AS rows FROM quotes UNION ALL SELECT 'trades', count(*) FROM trades", "quotes", "trades")
def table_counts(t: Tables) -> DataFrame:
    return store.table_counts({"quotes": t.quotes, "trades": t.trades})


@query(
    "ingest_reconciliation",
    "SELECT 'orders' AS table_name, client_order_id AS report_no, 0 AS item_no, status AS what FROM open_orders UNION ALL SELECT 'fills', client_order_id, 0, symbol FROM open_orders WHERE qty > 30 UNION ALL SELECT 'positions', client_order_id, i, concat(symbol, ':', i + 1) FROM open_orders, (VALUES (0), (1)) AS v(i) UNION ALL SELECT 'balances', client_order_id, 0, 'USDT:9' FROM open_orders UNION ALL SELECT 'reconciliation_audit', client_order_id, 0, 'x' FROM open_orders",
    "open_orders",
)
def ingest_reconciliation(t: Tables) -> DataFrame:
    order = F.struct("client_order_id", "symbol", "status", F.when(F.col("qty") > 30, F.col("qty").cast("string")).otherwise("0").alias("filled_qty"), F.lit("1.5").alias("avg_fill_price"))
    body = F.to_json(F.struct(F.array(order).alias("orders"), F.array(F.struct("symbol", F.lit("1").alias("qty")), F.struct("symbol", F.lit("2").alias("qty"))).alias("positions"), F.array(F.struct(F.lit("USDT").alias("asset"), F.lit("9").alias("total"))).alias("balances"), F.array(F.lit("x")).alias("audit_records")))
    tables = store.ingest_reconciliation(t.open_orders.select(F.col("client_order_id").alias("report_no"), body.alias("body")), "run-1")
    whole = lambda a, b: F.concat_ws(":", a, F.col(b).cast("long").cast("string"))
    return _rows(tables, "report_no", F.col("item_no").cast("long").alias("item_no"), orders=F.col("status"), fills=F.col("symbol"), positions=whole("symbol", "qty"), balances=whole("asset", "total"), reconciliation_audit=F.col("raw_json"))


@query("replace_by_source", "SELECT symbol AS source, row_no FROM trades WHERE symbol <> 'S1USDT' OR row_no % 2 = 0", "trades")
def replace_by_source(t: Tables) -> DataFrame:
    """Partitioned by source and day; the second ingest of one source has fewer days than the first."""
    path = store.scratch(t.spark, "by-source")
    own = t.trades.withColumn("source", F.col("symbol")).withColumn("day", F.date_format(F.timestamp_millis("local_ts_ms"), "yyyy-MM-dd"))
    store.replace_by_source(own, path)
    store.replace_by_source(own.where("symbol = 'S1USDT' AND row_no % 2 = 0"), path)
    return t.spark.read.parquet(path).select("source", "row_no")


@query("delete_source", "SELECT symbol AS source, row_no, venue FROM trades WHERE symbol <> 'S1USDT'", "trades")
def delete_source(t: Tables) -> DataFrame:
    path = store.scratch(t.spark, "by-source")
    store.replace_by_source(t.trades.withColumn("source", F.col("symbol")), path)
    store.delete_source(t.spark, path, "S1USDT")
    return t.spark.read.parquet(path).select("source", "row_no", "venue")


@query("upsert_by_key", "SELECT client_order_id, CASE WHEN CAST(substr(client_order_id, 5) AS BIGINT) % 3 = 0 THEN 'filled' ELSE status END AS status FROM open_orders UNION ALL SELECT 'new-' || client_order_id, 'filled' FROM open_orders WHERE CAST(substr(client_order_id, 5) AS BIGINT) % 3 = 0", "open_orders")
def upsert_by_key(t: Tables) -> DataFrame:
    old = t.open_orders.select("client_order_id", "status", F.lit(0).alias("row_no"))
    some = old.where("try_cast(substr(client_order_id, 5) AS BIGINT) % 3 = 0").withColumn("status", F.lit("filled"))
    earlier = some.withColumn("status", F.lit("accepted")).withColumn("row_no", F.lit(1))
    new = earlier.unionByName(some.withColumn("row_no", F.lit(2))).unionByName(some.withColumn("client_order_id", F.concat(F.lit("new-"), "client_order_id")))
    return store.upsert_by_key(old, new, "client_order_id").select("client_order_id", "status")


@query("load_events", "WITH b AS (SELECT row_no, local_ts_ms FROM quotes UNION ALL SELECT row_no, local_ts_ms FROM trades), d AS (SELECT strftime(make_timestamp(min(local_ts_ms) * 1000), '%Y-%m-%d') AS day FROM quotes) SELECT row_no FROM b, d WHERE strftime(make_timestamp(local_ts_ms * 1000), '%Y-%m-%d') = day", "quotes", "trades")
def load_events(t: Tables) -> DataFrame:
    facts = store.ingest_market_facts(ev.events_from_typed(t.quotes, t.trades), "day-1")
    path = {name: store.scratch(t.spark, name) for name in facts}
    for name, df in facts.items():
        store.replace_by_source(df, path[name])
    day = t.quotes.agg(F.date_format(F.timestamp_millis(F.min("local_ts_ms")), "yyyy-MM-dd")).first()[0]
    return store.load_events(*(t.spark.read.parquet(path[n]) for n in ("market_quotes", "market_trades")), source="day-1", day=day).select("row_no")


@query("union_quotes_trades", "SELECT row_no, symbol FROM quotes UNION ALL SELECT row_no, symbol FROM trades", "quotes", "trades")
def union_quotes_trades(t: Tables) -> DataFrame:
    return store.union_quotes_trades(store.ingest_market_facts(ev.events_from_typed(t.quotes, t.trades), "x")).select("row_no", "symbol")


@query("sql_query", "SELECT symbol, count(*) AS n FROM quotes WHERE venue = 'mexc' GROUP BY 1", "quotes")
def sql_query(t: Tables) -> DataFrame:
    return store.sql_query(t.spark, "SELECT symbol, count(*) AS n FROM {quotes} WHERE venue = :venue GROUP BY symbol", {"quotes": t.quotes}, {"venue": "mexc"})
