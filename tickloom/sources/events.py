"""Event files and their typed tables: JSON lines, flat Parquet, venue messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.exprs import contract_symbol, first_set

_L, _S = T.LongType(), T.StringType()
#: The event envelope; the payload stays JSON text.
EVENT = T.StructType(
    [T.StructField(n, t) for n, t in [("event_type", _S), ("venue", _S), ("market", _S), ("symbol", _S), ("local_ts_ms", _L), ("exchange_ts_ms", _L), ("receive_monotonic_ns", _L), ("payload", _S), ("schema_version", _S), ("captured_at_utc", _S), ("row_no", _L)]]
)
SCHEMA_VERSION = "1.0.0"


def read_events_jsonl(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events of JSON-lines files with a declared schema; blank lines leave. The payload object is read as text."""
    return spark.read.schema(EVENT).json(paths).where("event_type IS NOT NULL")


def append_events_jsonl(events: DataFrame, path: str) -> None:
    """Appends events; the payload is written as an object."""
    body = events.select(F.to_json(F.struct(*(F.parse_json("payload").alias("payload") if c == "payload" else F.col(c) for c in events.columns))).alias("value"))
    body.write.mode("append").text(path)


def flat(events: DataFrame) -> DataFrame:
    """Envelope rows with bid, ask and version lifted out of the payload, and day for partitions."""
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    return events.select(
        "event_type", "venue", "market", "symbol", "local_ts_ms", "exchange_ts_ms", "receive_monotonic_ns", get("bid_price").alias("bid_price"), get("ask_price").alias("ask_price"), get("version").alias("version"),
        F.col("payload").alias("payload_json"), "schema_version", "captured_at_utc", "row_no", F.to_date(F.substring("captured_at_utc", 1, 10)).alias("day"),
    )


def write_events_parquet(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Flat events in partitions by day and venue; one shuffle by those keys and a slice of time keeps files few and big days spread."""
    own = flat(events)
    spread = F.floor(first_set("local_ts_ms", "exchange_ts_ms") / 3_600_000)
    own.repartition("day", "venue", spread).write.mode(mode).partitionBy("day", "venue").parquet(path)


def read_events_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Envelope rows of flat events; a missing version or capture time gets its default. A day filter prunes partitions."""
    own = spark.read.parquet(path)
    return own.select("event_type", "venue", "market", "symbol", "local_ts_ms", "exchange_ts_ms", "receive_monotonic_ns", F.coalesce("payload_json", F.lit("{}")).alias("payload"), F.coalesce("schema_version", F.lit(SCHEMA_VERSION)).alias("schema_version"), F.coalesce("captured_at_utc", F.lit("")).alias("captured_at_utc"), "row_no", "day")


def convert_jsonl_to_parquet(spark: SparkSession, source: str | list[str], target: str) -> int:
    """Rows converted; they are counted while they are written."""
    seen = Observation()
    write_events_parquet(read_events_jsonl(spark, source).observe(seen, F.count(F.lit(1)).alias("rows")), target)
    return int(seen.get["rows"])


def _number(column: str | Column) -> Column:
    own = F.col(column) if isinstance(column, str) else column
    return own.try_cast("double")


def _payload(key: str) -> Column:
    return F.get_json_object("payload", f"$.{key}")


def quotes_from_events(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'book_ticker'").select(
        "row_no", first_set("local_ts_ms", "exchange_ts_ms").alias("local_ts_ms"), "exchange_ts_ms", "venue", "symbol", _number(_payload("bid_price")).alias("bid"), _number(_payload("ask_price")).alias("ask"), _number(_payload("bid_qty")).alias("bid_size"), _number(_payload("ask_qty")).alias("ask_size")
    )


def trades_from_events(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'trade'").select("row_no", first_set("local_ts_ms", "exchange_ts_ms").alias("local_ts_ms"), "exchange_ts_ms", "venue", "symbol", _number(_payload("price")).alias("price"), _number(_payload("qty")).alias("qty"), _payload("side").alias("side"))


def levels(json: Column) -> Column:
    """Array of (price, qty) from a JSON list of lists; a level of fewer than two values leaves."""
    raw = F.from_json(json, "array<array<string>>")
    return F.transform(F.filter(raw, lambda x: F.size(x) >= 2), lambda x: F.struct(x[0].try_cast("double").alias("price"), x[1].try_cast("double").alias("qty")))


def depth_from_events(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'orderbook_depth'").select("row_no", "local_ts_ms", "exchange_ts_ms", "venue", "symbol", levels(_payload("bids")).alias("bids"), levels(_payload("asks")).alias("asks"), _payload("version").try_cast("long").alias("version"))


def events_from_typed(quotes: DataFrame | None = None, trades: DataFrame | None = None, depth: DataFrame | None = None) -> DataFrame:
    """One envelope table of typed tables; numbers become decimal text in the payload."""
    text = lambda c, a: F.col(c).cast("string").alias(a)
    pairs = lambda c: F.transform(c, lambda x: F.array(x["price"].cast("string"), x["qty"].cast("string"))).alias(c)
    parts = []
    for df, kind, fields in (
        (quotes, "book_ticker", lambda: [text("bid", "bid_price"), text("bid_size", "bid_qty"), text("ask", "ask_price"), text("ask_size", "ask_qty")]),
        (trades, "trade", lambda: [text("price", "price"), text("qty", "qty"), F.col("side")]),
        (depth, "orderbook_depth", lambda: [pairs("bids"), pairs("asks")]),
    ):
        if df is not None:
            exchange = F.col("exchange_ts_ms") if "exchange_ts_ms" in df.columns else F.lit(None).cast("long")
            captured = F.date_format(F.timestamp_millis("local_ts_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
            parts.append(df.select(F.lit(kind).alias("event_type"), "venue", F.lit("usdt_perp").alias("market"), "symbol", "local_ts_ms", exchange.alias("exchange_ts_ms"), F.lit(None).cast("long").alias("receive_monotonic_ns"), F.to_json(F.struct(*fields())).alias("payload"), F.lit(SCHEMA_VERSION).alias("schema_version"), captured.alias("captured_at_utc"), F.col("row_no").cast("long").alias("row_no")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _in(body: str, *paths: str) -> Column:
    return F.coalesce(*(F.get_json_object(body, f"$.{p}") for p in paths))


def _either(*keys: str) -> list[str]:
    """A key inside `data` first, else at the top."""
    return [p for k in keys for p in (f"data.{k}", k)]


def _stamp(*keys: str) -> Column:
    return F.coalesce(*(F.nullif(_in("body", *_either(k)).try_cast("long"), F.lit(0).cast("long")) for k in keys))


def normalize_quote_messages(raw: DataFrame) -> DataFrame:
    """Venue messages (venue, body, row_no, local_ts_ms) -> quotes; shutdown notices and incomplete rows leave."""
    lead = raw.where("venue = 'binance'").where(~F.coalesce(_in("body", *_either("e")), F.lit("")).contains("serverShutdown")).select(
        "row_no", "venue", "local_ts_ms", _stamp("T", "E").alias("exchange_ts_ms"), F.upper(_in("body", *_either("s"))).alias("symbol"), _number(_in("body", *_either("b"))).alias("bid"), _number(_in("body", *_either("a"))).alias("ask"), _number(_in("body", *_either("B"))).alias("bid_size"), _number(_in("body", *_either("A"))).alias("ask_size")
    )
    none = F.lit(None).cast("double")
    lag = raw.where("venue = 'mexc'").select("row_no", "venue", "local_ts_ms", F.coalesce(_stamp("timestamp"), _stamp("ts")).alias("exchange_ts_ms"), contract_symbol(_in("body", *_either("symbol"))).alias("symbol"), _number(_in("body", "data.bid1")).alias("bid"), _number(_in("body", "data.ask1")).alias("ask"), none.alias("bid_size"), none.alias("ask_size"))
    return lead.unionByName(lag).where("symbol IS NOT NULL AND bid IS NOT NULL AND ask IS NOT NULL")


def normalize_trade_messages(raw: DataFrame) -> DataFrame:
    """aggTrade and trade messages -> trades; a buyer who is maker means an aggressive sell."""
    maker = _in("body", *_either("m"))
    own = raw.where(_in("body", *_either("e")).isin("aggTrade", "trade"))
    own = own.select("row_no", "venue", F.coalesce("local_ts_ms", _stamp("T", "E"), F.lit(0)).alias("local_ts_ms"), _stamp("T", "E").alias("exchange_ts_ms"), F.upper(_in("body", *_either("s"))).alias("symbol"), _number(_in("body", *_either("p"))).alias("price"), _number(_in("body", *_either("q"))).alias("qty"), F.when(maker == "true", "sell").when(maker == "false", "buy").alias("side"), F.coalesce(_in("body", *_either("a", "t")), F.lit("")).alias("trade_id"))
    return own.where("symbol IS NOT NULL AND price IS NOT NULL AND qty IS NOT NULL")


def normalize_depth_messages(raw: DataFrame) -> DataFrame:
    lag = F.col("venue") == "mexc"
    symbol = F.when(lag, contract_symbol(_in("body", "symbol", "data.symbol"))).otherwise(F.upper(_in("body", *_either("s"))))
    bids, asks = _in("body", *_either("bids", "b")), _in("body", *_either("asks", "a"))
    version = F.when(lag, _in("body", "data.version")).otherwise(_in("body", *_either("u", "lastUpdateId")))
    own = raw.select("row_no", "venue", "local_ts_ms", F.when(lag, F.coalesce(_stamp("ts"), _stamp("timestamp"), _stamp("ct"))).otherwise(_stamp("T", "E")).alias("exchange_ts_ms"), symbol.alias("symbol"), F.coalesce(levels(bids), F.array().cast("array<struct<price:double,qty:double>>")).alias("bids"), F.coalesce(levels(asks), F.array().cast("array<struct<price:double,qty:double>>")).alias("asks"), version.try_cast("long").alias("version"), bids.startswith("[").alias("_ok"))
    return own.where("symbol IS NOT NULL AND (_ok OR venue = 'mexc')").drop("_ok")


def normalize_symbol_info(raw: DataFrame) -> DataFrame:
    """Instrument metadata (venue, market, body) with each venue's rule for what can be traded."""
    get = lambda *k: _in("body", *k)
    rules = F.map_from_entries(F.transform(F.from_json(get("filters"), "array<map<string,string>>"), lambda f: F.struct(f["filterType"].alias("k"), f.alias("v"))))
    rule = lambda kind, key: F.try_element_at(F.try_element_at(rules, F.lit(kind)), F.lit(key))
    venue, perp = F.col("venue"), F.col("market") == "usdt_perp"
    status = F.coalesce(get("status"), get("state"), F.lit(""))
    allowed = F.coalesce(get("isSpotTradingAllowed"), F.lit("true")) == "true"
    enabled = (
        F.when((venue == "binance") & perp, (status == "TRADING") & (F.coalesce(get("contractType"), F.lit("")) == "PERPETUAL") & (F.coalesce(get("quoteAsset"), F.lit("")) == "USDT"))
        .when(venue == "binance", (status == "TRADING") & allowed).when(perp, status == "0").otherwise(status.isin("1", "TRADING", "ENABLED") & allowed)
    )
    return raw.select(
        "venue", "market", F.upper(get("symbol")).alias("symbol"), status.alias("status"), enabled.alias("trading_enabled"), ((venue == "binance") | (F.coalesce(get("apiAllowed"), F.lit("true")) == "true")).alias("api_allowed"),
        _number(F.coalesce(rule("PRICE_FILTER", "tickSize"), get("priceUnit"))).alias("price_tick"), _number(F.coalesce(rule("LOT_SIZE", "stepSize"), get("volUnit"))).alias("qty_step"), _number(F.coalesce(rule("LOT_SIZE", "minQty"), get("minVol"))).alias("min_qty"),
        _number(F.coalesce(rule("LOT_SIZE", "maxQty"), get("maxVol"))).alias("max_qty"), _number(F.coalesce(rule("MIN_NOTIONAL", "minNotional"), rule("MIN_NOTIONAL", "notional"), rule("NOTIONAL", "minNotional"), rule("NOTIONAL", "notional"))).alias("min_notional"), _number(get("contractSize")).alias("contract_size"),
        _number(get("makerFeeRate")).alias("maker_fee_rate"), _number(get("takerFeeRate")).alias("taker_fee_rate"),
    )


def normalize_stats_24h(raw: DataFrame) -> DataFrame:
    return raw.select("venue", "market", F.upper(_in("body", "symbol")).alias("symbol"), F.coalesce(_number(_in("body", "quoteVolume", "amount24")), F.lit(0.0)).alias("quote_volume"), _number(_in("body", "volume", "volume24")).alias("base_volume"), _number(_in("body", "lastPrice")).alias("last_price"))


def normalize_book_snapshots(raw: DataFrame) -> DataFrame:
    return raw.select("venue", "market", F.upper(_in("body", "symbol")).alias("symbol"), F.coalesce(_number(_in("body", "bidPrice", "bid1")), F.lit(0.0)).alias("bid"), F.coalesce(_number(_in("body", "askPrice", "ask1")), F.lit(0.0)).alias("ask"), _in("body", "time", "timestamp").try_cast("long").alias("ts_ms"))


def write_audit_jsonl(audit: DataFrame, path: str) -> None:
    """Audit rows as gzipped JSON lines; floating numbers are written as text, so no digit is lost."""
    own = audit.select(*(F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.DecimalType)) else F.col(f.name) for f in audit.schema.fields))
    own.write.mode("append").option("ignoreNullFields", "false").option("compression", "gzip").json(path)


def report_history(spark: SparkSession, path: str) -> DataFrame:
    """Rows of heterogeneous JSON reports (one a file): file, max_feed_gap_ms, intents, fills, pnl_usd and health (1, 0.5 or 0)."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    value = lambda k: F.coalesce(_number(_in("body", f"summary.{k}", f"paper_summary.{k}", k)), F.lit(0.0))
    streams = F.from_json(_in("body", "feed_health.streams", "health.streams"), "map<string,string>")
    gaps = F.transform(F.map_values(streams), lambda x: F.get_json_object(x, "$.max_gap_ms").try_cast("double"))
    status = F.lower(F.coalesce(F.nullif(_in("body", "system.status"), F.lit("")), _in("body", "feed_health.decision.reason"), F.lit("")))
    state = F.when(status.isin("", "ok", "healthy"), 1.0).when(status.isin("critical", "error"), 0.0).otherwise(0.5)
    return raw.select("file", F.coalesce(F.array_max(gaps), F.lit(0.0)).alias("max_feed_gap_ms"), value("intents").alias("intents"), value("fills").alias("fills"), (value("realized_pnl_usd") + value("unrealized_pnl_usd")).alias("pnl_usd"), state.alias("health"))
