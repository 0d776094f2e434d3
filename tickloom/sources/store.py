"""Tables as Parquet folders partitioned by source: idempotent ingest, upsert, deletion, loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.exprs import first_set
from tickloom.functions.scratch import scratch  # noqa: F401
from tickloom.operators.reports import DECISION, EXIT
from tickloom.sources.events import quotes_from_events, trades_from_events


def _folder(spark: SparkSession, path: str, **partition: str | None) -> tuple:
    """File system and path of a partition's folder, named as Spark's writer names it."""
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    own = "/".join([path, *(f"{k}={names.DEFAULT_PARTITION_NAME() if v is None else names.escapePathName(v)}" for k, v in partition.items())])
    where = spark._jvm.org.apache.hadoop.fs.Path(own)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def replace_by_source(new: DataFrame, path: str) -> None:
    """Rows of the sources in `new` replace those of the same sources; other sources stay. Ingesting twice changes nothing.

    A table with a day column is partitioned by source and day; days that a source no longer has go.
    """
    spark, days = new.sparkSession, "day" in new.columns
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", *(["day"] if days else [])).parquet(path)
    if not days:
        return
    there = {(r["source"], r["day"]) for r in new.select("source", "day").distinct().collect()}  # a row for each folder written
    for source in {s for s, _ in there}:
        fs, folder = _folder(spark, path, source=source)
        kept = {_folder(spark, path, source=source, day=d)[1].getName() for s, d in there if s == source}
        for found in fs.listStatus(folder):
            if found.isDirectory() and found.getPath().getName() not in kept:
                fs.delete(found.getPath(), True)


def delete_source(spark: SparkSession, path: str, source: str) -> None:
    """Drops the partition of one source; no other file is read or written."""
    fs, folder = _folder(spark, path, source=source)
    fs.delete(folder, True)


def upsert_by_key(old: DataFrame, new: DataFrame, key: str, order: str = "row_no") -> DataFrame:
    """Rows by key, the last writer winning: new before old, then the later row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*(c for c in both.columns if c != "_new")), F.struct("_new", order)).alias("r"))
    return best.select("r.*")


def ingest_market_facts(events: DataFrame, source: str) -> dict[str, DataFrame]:
    """market_quotes (book tickers and depth) and market_trades; other events leave. Both keep row_no and the raw payload; day is that of capture."""
    own = events.withColumn("source", F.lit(source)).withColumn("raw_json", F.col("payload")).withColumn("day", F.substring("captured_at_utc", 1, 10))
    columns = ["source", "day", "row_no", "event_type", "venue", "market", "symbol", "local_ts_ms", "exchange_ts_ms", "captured_at_utc", "raw_json"]
    return {"market_quotes": own.where("event_type IN ('book_ticker', 'orderbook_depth')").select(*columns), "market_trades": own.where("event_type = 'trade'").select(*columns)}


def ingest_audit_facts(audit: DataFrame, source: str) -> dict[str, DataFrame]:
    """signal_intents, order_facts, fill_facts (where a fill flag is set) and pnl_facts (exits) of one audit table."""
    own = audit.withColumn("source", F.lit(source))
    head = ["source", "row_no", "intent_id", "symbol", "timestamp_ms"]
    return {
        "signal_intents": own.where(F.col("event_type") == DECISION).select(*head, "model", "decision_result"),
        "order_facts": own.where(F.col("event_type") == DECISION).select(*head, "risk_allowed", "decision_result"),
        "fill_facts": own.where("fill_filled IS NOT NULL").select(*head, "fill_filled", "slippage_bps"),
        "pnl_facts": own.where(F.col("event_type") == EXIT).select(*head, "exit_reason", "gross_pnl_usd", "cost_usd", "realized_pnl_usd"),
    }


_REPORT = "struct<orders:array<struct<client_order_id:string,symbol:string,status:string,filled_qty:string,avg_fill_price:string>>,audit_records:array<string>,positions:array<struct<symbol:string,qty:string>>,balances:array<struct<asset:string,total:string>>>"


def ingest_reconciliation(reports: DataFrame, source: str) -> dict[str, DataFrame]:
    """Orders, fills (something filled at a known price), positions, balances and audit rows of report JSON (report_no, body)."""
    own = reports.select(F.lit(source).alias("source"), "report_no", F.from_json("body", _REPORT).alias("r"))
    items = lambda c: own.select("source", "report_no", F.posexplode(f"r.{c}").alias("item_no", "x"))
    orders = items("orders").select("source", "report_no", "item_no", "x.client_order_id", "x.symbol", "x.status", F.col("x.filled_qty").try_cast("double").alias("filled_qty"), F.col("x.avg_fill_price").try_cast("double").alias("avg_fill_price"))
    return {
        "orders": orders,
        "fills": orders.where("filled_qty > 0 AND avg_fill_price IS NOT NULL"),
        "positions": items("positions").select("source", "report_no", "item_no", "x.symbol", F.col("x.qty").try_cast("double").alias("qty")),
        "balances": items("balances").select("source", "report_no", "item_no", "x.asset", F.col("x.total").try_cast("double").alias("total")),
        "reconciliation_audit": items("audit_records").select("source", "report_no", "item_no", F.col("x").alias("raw_json")),
    }


def union_quotes_trades(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["market_quotes"].unionByName(tables["market_trades"])


def load_events(quotes: DataFrame, trades: DataFrame, source: str | None = None, day: str | None = None) -> DataFrame:
    """Stored events in canonical order; the filters on source and day prune partitions."""
    both = quotes.unionByName(trades)
    if source is not None:
        both = both.where(F.col("source") == source)
    if day is not None:
        both = both.where(F.col("day") == F.lit(day))
    return both.orderBy(first_set("local_ts_ms", "exchange_ts_ms"), first_set("exchange_ts_ms"), "venue", "symbol", "row_no")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows) of each table."""
    out = None
    for name, df in sorted(tables.items()):
        own = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = own if out is None else out.unionByName(own)
    return out


def sql_query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """SQL over tables named in braces, with named parameters; nothing is registered in the session."""
    return spark.sql(sql, args=args, **tables)


def typed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    return quotes_from_events(events), trades_from_events(events)
