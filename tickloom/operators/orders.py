"""Order reconciliation: private updates to order states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: field spellings of private updates, by meaning, in order of preference
ALIASES = {
    "client_order_id": ["ClientId", "clientId", "client_id", "ClientOrderId", "clientOrderId"],
    "status": ["Status", "status", "State", "state", "Event", "event"],
    "venue_order_id": ["OrderId", "orderId", "VenueOrderId", "venueOrderId", "Id", "id"],
    "ts_ms": ["Timestamp", "timestamp", "Time", "time", "Ts", "ts"],
    "filled_qty": ["FilledQty", "filledQty", "FilledVolume", "filledVolume", "ExecutedQty", "executedQty", "FilledSize", "filledSize"],
    "avg_fill_price": ["AvgFillPrice", "avgFillPrice", "AveragePrice", "averagePrice", "Price", "price", "FilledPrice", "filledPrice"],
    "symbol": ["Symbol", "symbol", "Ticker", "ticker"],
    "qty": ["Qty", "qty", "Volume", "volume", "Position", "position", "Size", "size"],
    "avg_price": ["AvgPrice", "avgPrice", "EntryPrice", "entryPrice", "Price", "price"],
    "asset": ["Asset", "asset", "Currency", "currency", "Coin", "coin"],
    "available": ["Available", "available", "Free", "free", "AvailableBalance", "availableBalance"],
    "total": ["Total", "total", "Balance", "balance", "Equity", "equity"],
    "connection_id": ["ConnectionId", "connectionId", "connection_id"],
    "reason": ["Reason", "reason", "Message", "message"],
}
LISTS = ["Orders", "orders", "Positions", "positions", "Balances", "balances", "Finreses", "finreses"]
PAYLOADS = ["Data", "data", "Payload", "payload"]
STATUS_EVENTS = {
    "accepted": ["0", "1", "accepted", "new", "open", "working", "placed"],
    "cancelled": ["cancelled", "canceled", "cancel"],
    "rejected": ["rejected", "reject", "error", "failed"],
    "fill": ["2", "filled", "partially_filled", "partial_fill", "fill", "execution", "closed"],
}


def _with_fields(rows: DataFrame, json: str, names: list[str], prefix: str) -> DataFrame:
    """rows with the named top-level fields of a JSON text, as prefix and number, out of one reading of it."""
    return rows.select("*", F.json_tuple(json, *names).alias(*(f"{prefix}{i}" for i in range(len(names)))))


def expand_private_updates(raw: DataFrame, body: str = "body") -> DataFrame:
    """Updates with a list payload as one row an item, which inherits the connection under either spelling; others pass through.

    Adds item_no, type (the outer one) and payload (JSON text). Items that are no objects leave; a list
    without objects passes through whole. Each text is read once, and for connections only where there are items.
    """
    n = len(PAYLOADS)
    own = _with_fields(raw, body, [*PAYLOADS, "Type", "type"], "_o")
    outer = F.coalesce(*(F.when(F.col(f"_o{i}").startswith("{"), F.col(f"_o{i}")) for i in range(n)), F.col(body))
    own = own.select(*(c for c in raw.columns if c not in ("_p", "type")), outer.alias("_p"), F.coalesce(f"_o{n}", f"_o{n + 1}").alias("type"))
    columns = own.columns
    own = _with_fields(own, "_p", LISTS, "_l")
    listed = F.coalesce(*(F.when(F.col(f"_l{i}").startswith("["), F.col(f"_l{i}")) for i in range(len(LISTS))))
    items = F.filter(F.from_json(listed, "array<string>"), lambda x: x.startswith("{"))
    own = own.select(*columns, F.explode(F.array(items)).alias("_items"))  # a step of its own, so that no reader of it reads the text again
    own = own.withColumn("_items", F.when(F.size("_items") > 0, F.col("_items")))
    links = ("ConnectionId", "connectionId")
    for i, name in enumerate(links):  # values keep their JSON type
        own = own.withColumn(f"_link{i}", F.when(F.col("_items").isNotNull(), F.expr(f"to_json(variant_get(try_parse_json(_p), '$.{name}', 'variant'))")))
    rows = own.select("*", F.posexplode_outer("_items").alias("item_no", "_item"))
    given = []
    for i, name in enumerate(links):
        there = F.expr(f"variant_get(try_parse_json(_item), '$.{name}', 'variant') IS NOT NULL")
        given.append(F.when(F.col(f"_link{i}").isNotNull() & ~F.coalesce(there, F.lit(False)), F.concat(F.lit(f'"{name}":'), f"_link{i}")))
    rows = rows.withColumn("_given", F.when(F.col("_item").isNotNull(), F.concat_ws(",", *given)))
    rest = F.when(F.regexp_like("_item", F.lit(r"^\{\s*\}$")), "}").otherwise(F.concat(F.lit(","), F.substring("_item", 2, 1 << 30)))
    inherit = F.when(F.col("_given") != "", F.concat(F.lit("{"), "_given", rest)).otherwise(F.col("_item"))
    return rows.withColumn("payload", F.coalesce(inherit, "_p")).withColumn("item_no", F.coalesce("item_no", F.lit(0))).drop("_p", "_items", "_item", "_given", *(f"_link{i}" for i in range(len(links))))


def order_event_type(status: Column, filled_qty: Column) -> Column:
    """fill if anything is filled, else by the status text or code; null if unknown."""
    text = F.lower(F.coalesce(status, F.lit("")))
    out = F.when(filled_qty > 0, "fill")
    for kind, texts in STATUS_EVENTS.items():
        out = out.when(text.isin(texts), kind)
    return out


def classify_private_updates(rows: DataFrame, body: str = "body") -> DataFrame:
    """Expanded rows with kind (position, balance, order or unknown) and typed columns; the first that fits in this order."""
    own = _with_fields(rows, body, ["Type", "type", "Event", "event", "Channel", "channel"], "_o")
    own = _with_fields(own, "payload", ["Type", "type"], "_i")
    text = F.lower(F.concat_ws(" ", "type", *(f"_o{i}" for i in range(6)), "_i0", "_i1"))
    # the fields are a step of their own: filters on what is made of them would read the text again for each mention
    own = own.select(*rows.columns, text.alias("_text"), F.explode(F.array(F.from_json("payload", "map<string,string>"))).alias("_fields"))
    first = lambda names: F.get(F.filter(F.transform(F.array(*(F.lit(n) for n in names)), lambda n: F.try_element_at("_fields", n)), lambda x: x.isNotNull()), 0)
    own = own.withColumns({n: first(names) for n, names in ALIASES.items()})
    for n in ("filled_qty", "avg_fill_price", "qty", "avg_price", "available", "total"):
        own = own.withColumn(n, F.expr(f"try_cast({n} AS DOUBLE)"))
    own = own.withColumn("ts_ms", F.coalesce(F.expr("try_cast(ts_ms AS BIGINT)"), F.lit(0)))
    own = own.withColumn("client_order_id", F.nullif("client_order_id", F.lit(""))).withColumn("reason", F.nullif("reason", F.lit(""))).withColumn("order_event", order_event_type(F.col("status"), F.coalesce("filled_qty", F.lit(0.0))))
    known = F.col("client_order_id").isNotNull() & F.col("order_event").isNotNull()
    kind = F.when(F.col("_text").contains("position"), "position").when(F.col("_text").contains("balance") | F.col("_text").contains("wallet"), "balance").when(known, "order").otherwise("unknown")
    return own.withColumn("kind", kind).drop("_text", "_fields")


def updates_of_orders(classified: DataFrame) -> DataFrame:
    """The order updates among classified rows, as the order folds take them."""
    return classified.where("kind = 'order'").select("row_no", "item_no", "client_order_id", F.col("order_event").alias("event_type"), F.coalesce("filled_qty", F.lit(0.0)).alias("filled_qty"), "avg_fill_price", "venue_order_id", "reason", "ts_ms")


def orders_from_submissions(audit: DataFrame, ttl_ms: int) -> DataFrame:
    """Initial order states: unknown and accepted submissions are open until now + ttl, dry runs planned, others rejected."""
    unknown, decision = F.coalesce("unknown_status", F.lit(False)), F.col("decision_result")
    status = F.when(unknown, "unknown").when(decision == "accepted", "accepted").when(decision == "dry_run_planned", "planned").otherwise("rejected")
    opened = unknown | (decision == "accepted")
    return audit.select(F.coalesce("client_id_returned", "client_id").alias("client_order_id"), "symbol", "qty", status.alias("status"), opened.alias("open"), F.when(opened, F.col("now_ts_ms")).alias("accepted_ts_ms"), F.when(opened, F.col("now_ts_ms") + ttl_ms).alias("expires_ts_ms"))


def order_state_timeline(orders: DataFrame, updates: DataFrame) -> DataFrame:
    """State after each update of a known order, in arrival order; the last event decides, so a fill after a cancel reopens.

    Adds filled_max (running), before_status, after_status, open_after, and as last known: avg_fill_price (of fills, 0
    is none), venue_order_id (not of rejections) and reject_reason (of the last rejection). Events of other kinds change
    no status. updates may lack venue_order_id and reason, orders may lack venue_order_id and open.
    """
    own = updates
    for name in ("venue_order_id", "reason"):
        own = own if name in own.columns else own.withColumn(name, F.lit(None).cast("string"))
    given = orders.select(
        "client_order_id", "symbol", "qty", "status", (F.col("venue_order_id") if "venue_order_id" in orders.columns else F.lit(None).cast("string")).alias("_venue_id"),
        (F.col("open") if "open" in orders.columns else F.col("status").isin("accepted", "unknown")).alias("_open"),
    )
    own = own.join(given, "client_order_id")
    w = Window.partitionBy("client_order_id").orderBy("row_no")
    last = lambda c: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kind = F.col("event_type")
    is_fill = kind == "fill"
    filled = F.max(F.when(is_fill, F.col("filled_qty"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = own.withColumn("filled_max", F.greatest(F.lit(0.0), F.coalesce(filled, F.lit(0.0))))
    after = F.when(is_fill, F.when(F.col("filled_max") >= F.col("qty"), "filled").otherwise("partially_filled")).when(kind.isin("accepted", "cancelled", "rejected"), kind)
    own = own.withColumn("_after", last(after)).withColumn("avg_fill_price", last(F.when(is_fill, F.nullif("avg_fill_price", F.lit(0.0)))))
    own = own.withColumn("venue_order_id", F.coalesce(last(F.when(kind.isin("accepted", "fill", "cancelled"), F.nullif("venue_order_id", F.lit("")))), "_venue_id"))
    own = own.withColumn("reject_reason", last(F.when(kind == "rejected", F.struct("reason")))["reason"])
    own = own.withColumn("after_status", F.coalesce("_after", "status")).withColumn("before_status", F.coalesce(F.lag("_after").over(w), "status"))
    return own.withColumn("open_after", F.when(F.col("_after").isNull(), F.col("_open")).otherwise(F.col("_after").isin("accepted", "partially_filled"))).drop("_after", "_venue_id", "_open")


def order_state_final(orders: DataFrame, updates: DataFrame) -> DataFrame:
    """Last state of every order; one without updates keeps its initial state."""
    last = order_state_timeline(orders, updates).groupBy("client_order_id").agg(F.max_by(F.struct("after_status", "filled_max", "avg_fill_price", "open_after", "ts_ms"), "row_no").alias("s"))
    own = orders.join(last, "client_order_id", "left")
    return own.select("client_order_id", "symbol", "qty", F.coalesce("s.after_status", "status").alias("status"), F.coalesce("s.filled_max", F.lit(0.0)).alias("filled_qty"), F.col("s.avg_fill_price").alias("avg_fill_price"), F.coalesce("s.open_after", F.col("status").isin("accepted", "unknown")).alias("open"), "expires_ts_ms")


def ttl_expired_orders(states: DataFrame, now_ms: int) -> DataFrame:
    return states.where(F.col("open") & (F.col("expires_ts_ms") <= now_ms))


def unmatched_updates(orders: DataFrame, updates: DataFrame) -> DataFrame:
    return updates.join(orders.select("client_order_id"), "client_order_id", "left_anti")


def match_updates(orders: DataFrame, updates: DataFrame) -> DataFrame:
    return updates.join(orders.select("client_order_id", "symbol"), "client_order_id")


def reconciliation_audit(orders: DataFrame, classified: DataFrame) -> DataFrame:
    """classified (rows of classify_private_updates) with audit_event and decision_result, an audit record each.

    Order updates of unknown clients are unmatched; what is no position, balance or order is unknown.
    """
    own = classified.join(orders.select("client_order_id", F.lit(True).alias("_known")), "client_order_id", "left")
    kind = F.col("kind")
    result = F.when(kind.isin("position", "balance"), F.concat(kind, F.lit("_snapshot"))).when(kind == "unknown", "unknown_update").when(F.col("_known"), "order_reconciled").otherwise("unmatched_order_update")
    return own.withColumn("audit_event", F.concat(kind, F.lit("_update"))).withColumn("decision_result", result).drop("_known")


def reconciliation_summary(orders: DataFrame, classified: DataFrame) -> DataFrame:
    """One row of counts: orders, updates (before lists are expanded), audit_records, positions, balances, unmatched and unknown."""
    is_ = lambda r: F.count_if(F.col("decision_result") == r)
    counts = reconciliation_audit(orders, classified).agg(
        F.count_if(F.col("item_no") == 0).alias("updates"), F.count("*").alias("audit_records"), is_("position_snapshot").alias("positions"), is_("balance_snapshot").alias("balances"),
        is_("unmatched_order_update").alias("unmatched_updates"), is_("unknown_update").alias("unknown_updates"),
    )
    return counts.crossJoin(orders.agg(F.count("*").alias("orders")))
