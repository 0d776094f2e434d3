"""Steps whose work must grow no faster than their input."""

from __future__ import annotations

import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from tickloom.functions import scratch as folders
from tickloom.functions.scratch import scratch
from tickloom.functions.exprs import event_order, mid
from tickloom.operators import leadlag, orders, outcomes
from tickloom.operators.asof import latest_pair
from tickloom.plans import live
from tickloom.plans.registry import Tables
from tickloom.sources import events
from tickloom.streaming import online


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_aligned_returns_frames_only_grow(spark):
    """A frame with two moving ends is gone through anew for every row, so dense returns cost their square."""
    df = spark.createDataFrame([], "row_no long, symbol string, venue string, ts long, ret double")
    frames = re.findall(r"specifiedwindowframe\(([^)]*\))", plan_of(leadlag.aligned_returns(df, [0, 25], 9)))
    assert frames and all("unboundedpreceding" in f for f in frames)


def test_aligned_returns_of_dense_ticks(spark):
    """30,000 returns within one tolerance; each meets the other venue's first one."""
    df = spark.range(30_000).select(F.col("id").alias("row_no"), F.lit("A").alias("symbol"), F.when(F.col("id") % 2 == 0, "binance").otherwise("mexc").alias("venue"), (F.col("id") % 10).alias("ts"), F.col("id").cast("double").alias("ret"))
    got = leadlag.aligned_returns(df, [0], 20).groupBy("direction").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).collect()
    assert {tuple(r) for r in got} == {("binance", 15_000, 1.0, 1.0), ("mexc", 15_000, 0.0, 0.0)}


def test_stretches_land_by_many_tasks(spark, monkeypatch):
    """What lands is not drawn through one task, and each stretch is a batch of its own."""
    seen, checkpoint, landed = [], scratch(spark, "checkpoint"), scratch(spark, "landed")
    monkeypatch.setattr(live, "scratch", lambda *_: landed)
    write = lambda batch, n: seen.append((n, *batch.agg(F.count("*"), F.min("id"), F.max("id")).first()))
    live._fed(Tables(spark, ""), spark.range(0, 8000, numPartitions=4), "id", 2, lambda stream: online.run_batches(stream, write, checkpoint, "append"))
    assert [s[0] for s in seen] == [0, 1] and sum(s[1] for s in seen) == 8000 and seen[0][3] < seen[1][2]
    assert len(list(Path(landed.removeprefix("file:")).glob("*.parquet"))) > 2


def test_kept_rows_are_aggregated_in_small_parts(spark, monkeypatch):
    """A task's aggregate is bounded by the bytes it reads, however few shuffle partitions the session has, and the session's settings stay."""
    monkeypatch.setattr(folders, "PART_BYTES", 1 << 20, raising=False)
    before = dict(spark.conf.getAll)
    own = folders.kept(spark.range(2_000_000).select((F.col("id") * 3).alias("id")).groupBy("id").agg(F.max("id").alias("most")), "parts")
    assert own.count() == 2_000_000 and own.agg(F.sum("most")).first()[0] == 3 * sum(range(2_000_000))
    sizes = [r["count"] for r in own.groupBy(F.input_file_name()).count().collect()]
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) < len(sizes) and max(sizes) < 400_000
    assert dict(spark.conf.getAll) == before


def test_order_states_over_batches_without_python(spark):
    """Arrival is the batch first, then row_no; what an order's batches leave open stays as it was."""
    known = spark.createDataFrame([("a", 5.0, "accepted", "k", True), ("b", 2.0, "unknown", None, True), ("c", 2.0, "planned", "z", False)], "client_order_id string, qty double, status string, venue_order_id string, open boolean")
    schema = "client_order_id string, row_no long, event_type string, filled_qty double, avg_fill_price double, venue_order_id string, reason string"
    batches = [
        [("a", 9, "fill", 4.0, 7.0, "v", None), ("a", 8, "rejected", 9.0, 3.0, "w", "r"), ("b", 5, "noted", 1.0, 1.0, "n", "n"), ("x", 1, "fill", 1.0, 1.0, "x", None)],
        [("a", 3, "fill", 1.0, 0.0, "", None), ("b", 2, "fill", None, None, None, None), ("c", 1, "noted", 1.0, 1.0, "n", "n")],
        [("a", 1, "fill", 5.0, float("nan"), "u", "q"), ("b", 1, "rejected", None, None, "n", None)],
    ]
    path, checkpoint, got = scratch(spark, "landed"), scratch(spark, "checkpoint"), []
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        own = online.stream_order_state(online.stream_quotes(spark, path, spark.createDataFrame([], schema).schema), known)
        online.run_batches(own, lambda batch, n: got.append(sorted(tuple(r) for r in batch.collect())), checkpoint, many_keys=True)
    assert got == [
        [("a", "partially_filled", 4.0, 7.0, "v", "r", True, 2), ("b", "unknown", 0.0, None, None, None, True, 1)],
        [("a", "partially_filled", 4.0, 7.0, "v", "r", True, 3), ("b", "partially_filled", 0.0, None, None, None, True, 2), ("c", "planned", 0.0, None, "z", None, False, 1)],
        [("a", "filled", 5.0, 7.0, "u", "r", False, 4), ("b", "rejected", 0.0, None, None, None, False, 3)],
    ]
    assert "Pandas" not in plan_of(online.stream_order_state(spark.createDataFrame(batches[0], schema), known))


def test_private_updates_read_each_text_once(spark):
    """A filter on the kind does not repeat the reading of the text for each mention of a field."""
    raw = spark.createDataFrame([(1, '{"Type":"OrderUpdate","Data":{"ClientId":"a","Status":"new"}}')], "row_no long, body string")
    own = orders.classify_private_updates(orders.expand_private_updates(raw)).where("kind = 'order'")
    assert [r["client_order_id"] for r in own.collect()] == ["a"]
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 0 and plan.count("from_json(MapType") + plan.count("map<string,string>") + plan.count("JsonToStructsEvaluator") <= 4


def test_audit_lines_are_compressed(spark):
    path = scratch(spark, "audit")
    events.write_audit_jsonl(spark.range(1000).select(F.col("id").alias("row_no"), F.lit(0.1).alias("pnl")), path)
    assert all(f.name.endswith(".json.gz") for f in Path(path.removeprefix("file:")).glob("part-*"))
    assert spark.read.json(path).where("pnl = '0.1'").count() == 1000


_ENTRY = "entry_id string, symbol string, side string, qty double, entry_price double, entry_ts_ms long, model string, mean double, sigma double, beta double"
_TICK = "row_no long, symbol string, venue string, local_ts_ms long, exchange_ts_ms long, bid double, ask double"


def test_exits_of_dense_ticks(spark):
    """20,000 entries and 20,000 ticks within a second; each entry is met by the last tick alone, so pairs of both are 400 million."""
    ticks = spark.range(20_001).select("id", F.lit("S").alias("symbol"), F.lit("mexc").alias("venue"), (F.col("id") / 20).cast("long").alias("local_ts_ms"), F.lit(0).cast("long").alias("exchange_ts_ms"), F.when(F.col("id") == 20_000, 110.0).otherwise(100.0).alias("bid"))
    ticks = ticks.select(F.col("id").alias("row_no"), *ticks.columns[1:], (F.col("bid") + 1).alias("ask"))
    entries = spark.range(20_000).select(F.col("id").cast("string").alias("entry_id"), F.lit("S").alias("symbol"), F.lit("buy").alias("side"), F.lit(1.0).alias("qty"), F.lit(101.0).alias("entry_price"), (F.col("id") / 20).cast("long").alias("entry_ts_ms"), F.lit("impulse_transfer").alias("model"))
    entries = entries.select(*entries.columns, *(F.lit(None).cast("double").alias(c) for c in ("mean", "sigma", "beta")))
    found = outcomes._first_met(entries.withColumn("expires_ts_ms", F.col("entry_ts_ms") + 32_000), ticks.select("symbol", "row_no", F.col("local_ts_ms").alias("ts"), "bid", "ask", F.col("bid").alias("mid"), F.col("local_ts_ms").alias("leader_ts"), F.lit(100.0).alias("leader_mid")), 32_000, 40.0, None, 0.4, 4.0)
    assert "Join" not in plan_of(found)
    assert {tuple(r) for r in found.groupBy("row_no", "ts").count().collect()} == {(20_000, 1000, 20_000)}


def test_exits_against_all_pairs(spark):
    """Nulls, NaN, prices that do not move, both signs of a quantity, any beta, and lives across chunks."""
    rng, nan = random.Random(3), float("nan")
    rows = [(k, rng.choice("ST"), rng.choice(["binance", "mexc", "mexc"]), rng.randrange(20_000) * 1000, 0, rng.choice([100.0 + rng.gauss(0, 1)] * 30 + [None, nan]), rng.choice([101.0 + rng.gauss(0, 1)] * 30 + [None, nan])) for k in range(3000)]
    entries = []
    for k in range(1500):
        sigma, beta, mean = rng.choice([30.0, 10.0, 90.0, 400.0, 0.0, None, nan]), rng.choice([1.0, 1.0, 0.9, 1.1, 0.0, None, nan]), rng.choice([0.0, 50.0, -70.0, 100.0, -100.0, 50.0, None, nan])
        if beta in (0.9, 1.1):
            mean = (1 - beta) * 46_060 + rng.gauss(0, 200)
        price, at = rng.choice([100.0 + rng.gauss(0, 2)] * 30 + [None, nan, 0.0]), rng.choice([rng.randrange(20_000) * 1000] * 30 + [None])
        entries.append((str(k), rng.choice("ST"), rng.choice(["buy", "sell", "buy", "sell", None]), rng.choice([1.0, 2.0, -1.0, 0.0, None]), price, at, rng.choice(["residual_zscore", "impulse_transfer", None]), mean, sigma, beta))
    quotes, entries = spark.createDataFrame(rows, _TICK), spark.createDataFrame(entries, _ENTRY)
    pairs = latest_pair(quotes.withColumn("mid", mid()), "binance", "mexc", event_order(), ["local_ts_ms", "mid"]).where("venue = 'mexc'")
    ticks = pairs.select("symbol", "row_no", F.col("local_ts_ms").alias("ts"), "bid", "ask", mid().alias("mid"), F.col("leader.local_ts_ms").alias("leader_ts"), F.col("leader.mid").alias("leader_mid"))
    for ttl, profit, stale in ((2_000_000, 150.0, 60_000), (9_000_000, 300.0, None), (500_000, None, 90_000), (300_000, -5.0, None), (9_000_000, None, None)):
        all_pairs = entries.withColumn("expires_ts_ms", F.col("entry_ts_ms") + ttl).join(ticks, "symbol").where("ts > entry_ts_ms").withColumn("reason", outcomes._exit_reason(profit, stale, 0.4, 4.0)).where("reason IS NOT NULL")
        first = all_pairs.groupBy("entry_id").agg(F.min_by(F.struct("reason", "row_no"), F.struct("ts", "row_no")).alias("x"))
        want = {r["entry_id"]: tuple(r["x"]) if r["x"] else (None, None) for r in entries.select("entry_id").join(first, "entry_id", "left").collect()}
        got = outcomes.label_exits(entries, quotes, ttl, profit, stale).collect()
        assert {r["entry_id"]: (r["exit_reason"], r["exit_row"]) for r in got} == want and len(got) == len(want)
