"""Worked examples, naive loops on random series, and independence from partitioning."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.functions import exprs as E
from tickloom.operators import asof, health, leadlag, orders, outcomes, reports, risk, signals, windows
from tickloom.sources import store

QUOTE = "row_no long, local_ts_ms long, exchange_ts_ms long, venue string, symbol string, bid double, ask double, bid_size double, ask_size double"


def quotes(spark, rows):
    """rows of (ts, venue, mid) on one symbol; bid and ask lie on the mid."""
    return spark.createDataFrame([(i, ts, ts, v, "S", float(m), float(m), 5.0, 5.0) for i, (ts, v, m) in enumerate(rows)], QUOTE)


def random_quotes(n=400, seed=1):
    rng = random.Random(seed)
    ts, out = 0, []
    for i in range(n):
        ts += rng.choice([0, 0, 1, 3, 40, 700])
        v = rng.choice(["binance", "mexc"])
        out.append((i, ts, ts - rng.randint(0, 3), v, rng.choice(["A", "B"]), 100 + rng.random(), 101 + rng.random(), 1.0, 1.0))
    return out


def test_feed_gaps(spark):
    q = quotes(spark, [(0, "binance", 1), (100, "binance", 1), (700, "binance", 1), (50, "mexc", 1)])
    got = {r["venue"]: r for r in health.feed_health(q, 500).collect()}
    assert (got["binance"]["max_gap_ms"], got["binance"]["stale_gap_count"]) == (600, 1)
    decision = health.feed_decision(health.feed_health(q, 500), q, 500).collect()
    assert {r["reason"] for r in decision} == {"stale_stream"}


def test_impulse_long(spark):
    q = quotes(spark, [(0, "binance", 100), (0, "mexc", 100), (100, "binance", 101), (100, "mexc", 100)])
    got = signals.impulse_signals(q, (100,)).collect()
    assert [(r["ts"], r["side"], round(r["impulse_bps"]), round(r["lag_bps"])) for r in got] == [(100, "buy", 100, 100)]


def test_leadership_and_mirror(spark):
    mids = [100, 101, 100.5, 102, 101.5, 103, 102.75, 104]
    lead = [(100 * i, "binance", m) for i, m in enumerate(mids)]
    follow = quotes(spark, lead + [(100 * i + 100, "mexc", m) for i, m in enumerate(mids)])
    r = leadlag.leadership(follow, [25, 50, 100, 200], min_pairs=3).first()
    assert (r["leader"], r["lag_ms"], r["reason"]) == ("binance", 100, "ok")
    mirror = quotes(spark, lead + [(100 * i + 100, "mexc", 200 - m) for i, m in enumerate(mids)])
    assert leadlag.leadership(mirror, [100], min_pairs=3).first()["reason"] == "unstable"


def test_lag_selection(spark):
    rows = [("S", 50, 5.0, 4.8, 0.2)] * 3 + [("S", 100, 5.0, -2.0, -0.1)] * 3
    obs = spark.createDataFrame(rows, "symbol string, lag_ms long, predicted_move_bps double, actual_move_bps double, paper_pnl_usd double")
    stats = leadlag.lag_candidate_stats(obs, [50, 100])
    assert leadlag.lag_selection(stats, 3).first()["lag_ms"] == 50
    assert leadlag.lag_selection(stats, 4).first()["reason"] == "insufficient_samples"
    with pytest.raises(Exception, match="unsupported lag"):
        leadlag.lag_candidate_stats(obs, [50]).collect()


def test_published_cost_sensitivity(spark):
    rows = spark.createDataFrame([(0.4266, 9939.1626 / 2)], "gross_pnl_usd double, notional double")
    got = {r["cost_bps"]: r for r in reports.cost_sensitivity(rows, [1, 12]).collect()}
    assert round(got[1.0]["break_even_bps"], 4) == 0.4292
    assert round(got[1.0]["net_pnl_usd"], 8) == -0.56731626
    assert round(got[12.0]["net_pnl_usd"], 8) == -11.50039512


def test_order_fold(spark):
    known = spark.createDataFrame([("a", "S", 2.0, "accepted", 9)], "client_order_id string, symbol string, qty double, status string, expires_ts_ms long")
    up = [(1, "a", "accepted", 0.0), (2, "a", "fill", 1.0), (3, "a", "fill", 2.0), (4, "x", "fill", 1.0)]
    up = spark.createDataFrame([(*u, 1.0, u[0]) for u in up], "row_no long, client_order_id string, event_type string, filled_qty double, avg_fill_price double, ts_ms long")
    r = orders.order_state_final(known, up).first()
    assert (r["status"], r["filled_qty"], r["open"]) == ("filled", 2.0, False)
    assert orders.unmatched_updates(known, up).count() == 1
    reopened = up.where("row_no < 3").unionByName(up.where("row_no = 1").withColumn("row_no", F.lit(0).cast("long")).withColumn("event_type", F.lit("cancelled")))
    assert orders.order_state_final(known, reopened).first()["status"] == "partially_filled"


def test_ttl_exit(spark):
    q = quotes(spark, [(0, "binance", 101), (100, "mexc", 100), (150, "mexc", 101), (200, "mexc", 102)])
    entry = spark.createDataFrame([("e", "S", "buy", 1.0, 100.0, 100, "impulse_transfer", None, None, None)], "entry_id string, symbol string, side string, qty double, entry_price double, entry_ts_ms long, model string, mean double, sigma double, beta double")
    r = outcomes.label_exits(entry, q, 100, None, None).first()
    assert (r["exit_reason"], r["realized_pnl_usd"], r["exit_ts_ms"]) == ("ttl_exit", 2.0, 200)
    assert outcomes.label_exits(entry, q, 100, 50.0, None).first()["exit_reason"] == "take_profit"
    assert outcomes.label_exits(entry, q, 100, None, 120).first()["exit_reason"] == "stale_data_stop"


@pytest.mark.parametrize("chunk", [None, 50, 1000])
def test_asof_against_loop(spark, chunk):
    rows = random_quotes()
    df = spark.createDataFrame(rows, QUOTE)
    left, right = df.where("venue = 'binance'"), df.where("venue = 'mexc'")
    back = {r["row_no"]: r["v"] for r in asof.asof_backward(left, right, ["symbol"], F.col("row_no"), "v", chunk_ms=chunk).collect()}
    strict = {r["row_no"]: r["v"] for r in asof.asof_backward(left, right, ["symbol"], F.col("row_no"), "v", strict=True, chunk_ms=chunk).collect()}
    ahead = {r["row_no"]: r["v"] for r in asof.asof_forward(left, right, ["symbol"], F.col("row_no"), "v", chunk_ms=chunk).collect()}
    for i, ts, _, v, s, *_ in rows:
        if v == "binance":
            same = [(r[1], r[0]) for r in rows if r[3] == "mexc" and r[4] == s]
            assert back[i] == max(((t, k) for t, k in same if t <= ts), default=(0, None))[1]
            assert strict[i] == max(((t, k) for t, k in same if t < ts), default=(0, None))[1]
            assert ahead[i] == min(((t, k) for t, k in same if t >= ts), default=(0, None))[1]


@pytest.mark.parametrize("chunk", [50, 1000])
def test_lookback_and_tolerance_against_loop(spark, chunk):
    rows = random_quotes(seed=7)
    df = spark.createDataFrame(rows, QUOTE)
    got = asof.asof_lookback(df, {"short": 7, "long": 45}, F.col("row_no"), chunk_ms=chunk).collect()
    assert len(got) == len(rows)
    for r in got:
        for name, w in (("short", 7), ("long", 45)):
            past = [(x[1], x[0]) for x in rows if x[3] == r["venue"] and x[4] == r["symbol"] and x[1] <= r["local_ts_ms"] - w]
            assert r[name] == max(past, default=(0, None))[1]
    own = df.withColumn("ts", F.col("local_ts_ms"))
    near = asof.asof_tolerance(own.where("venue = 'binance'"), own.where("venue = 'mexc'"), ["symbol"], F.col("row_no"), "v", 5, chunk_ms=chunk).collect()
    for r in near:
        after = min(((x[1], x[0]) for x in rows if x[3] == "mexc" and x[4] == r["symbol"] and x[1] >= r["ts"] - 5), default=(1 << 60, None))
        assert r["v"] == (after[1] if abs(after[0] - r["ts"]) <= 5 else None)


def test_a_hot_symbol_is_split(spark):
    """One symbol over ten days: every window on its ticks is dealt out by chunks of time as well."""
    quotes = spark.createDataFrame([(k, k * 864_000, k * 864_000, "binance" if k % 2 else "mexc", "S", 100.0 + k % 7, 101.0 + k % 7, 1.0, 1.0) for k in range(1000)], QUOTE)
    frames = [
        windows.previous_quote(quotes), windows.feed_gaps(quotes), windows.basis_samples(quotes), asof.asof_lookback(quotes, {"back": 1000}, F.col("bid")),
        asof.asof_backward(quotes.where("venue = 'mexc'"), quotes.where("venue = 'binance'"), ["symbol"], F.col("bid"), "v"), windows.running_sums(quotes, ["symbol"], "local_ts_ms", E.event_order(), {"x": F.col("bid")}),
    ]
    for df in frames:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        keys = [line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in plan.splitlines() if "windowspecdefinition" in line]
        assert keys and all(re.search("_chunk|_upper", k) for k in keys)
        assert df.count() > 0


@pytest.mark.parametrize("chunk", [50, 1000])
def test_chunks_change_nothing(spark, chunk):
    df = spark.createDataFrame(random_quotes(seed=2), QUOTE)
    for f in (
        lambda c: asof.running_last(df, ["symbol"], "local_ts_ms", E.event_order(), {"x": F.when(F.col("venue") == "mexc", F.col("bid"))}, current=False, chunk_ms=c),
        lambda c: windows.with_position(df, ["symbol"], "local_ts_ms", E.event_order(), chunk_ms=c),
        lambda c: windows.running_sums(df, ["symbol"], "local_ts_ms", E.event_order(), {"x": F.col("row_no")}, chunk_ms=c),
    ):
        one, other = f(None), f(chunk)
        assert sorted(map(str, one.select(sorted(one.columns)).collect())) == sorted(map(str, other.select(sorted(other.columns)).collect()))


def test_ewm_against_loop(spark):
    samples = windows.basis_samples(spark.createDataFrame(random_quotes(600, 3), QUOTE)).cache()
    got = {(r["symbol"], r["position"]): r for r in windows.ewm_basis(samples, 7).collect()}  # 300 windows are 2100 ms: many blocks
    for s in "AB":
        mean = var = last = None
        for r in sorted((r for r in samples.collect() if r["symbol"] == s), key=lambda r: r["position"]):
            x, ts, g = r["basis"], r["ts"], got[s, r["position"]]
            assert (g["prior_mean"] is None) == (mean is None)
            if mean is None:
                mean, var = x, 0.0
            else:
                assert math.isclose(g["prior_mean"], mean, abs_tol=1e-7) and math.isclose(g["prior_var"], var, abs_tol=1e-6)
                a = 1 - math.exp(-max(0, ts - last) / 7)
                mean, var = mean + a * (x - mean), (1 - a) * (var + a * (x - mean) ** 2)
            last = ts
    samples.unpersist()


def test_rolling_mean_across_blocks(spark):
    samples = windows.basis_samples(spark.createDataFrame(random_quotes(300, 4), QUOTE))
    small, large = ({(r["symbol"], r["position"]): (r["rolling_count"], round(r["rolling_mean"] or 0, 9)) for r in windows.rolling_basis_mean(samples, 5, b).collect()} for b in (8, 4096))
    assert small == large


def test_replace_twice_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "source string, x int")
    for _ in range(2):
        store.replace_by_source(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_expand_keeps_odd_updates(spark):
    raw = spark.createDataFrame([(1, '{"Type":"Orders","Data":{"ConnectionId":3,"Orders":[{"ClientId":"a","Status":"new"},{"ConnectionId":4,"ClientId":"b","Status":"zzz"},5]}}'), (2, "not json"), (3, '{"Data":{"Orders":[]}}'), (4, None)], "row_no long, body string")
    got = orders.classify_private_updates(orders.expand_private_updates(raw)).orderBy("row_no", "item_no").collect()
    assert [(r["row_no"], r["kind"], r["client_order_id"], r["connection_id"]) for r in got] == [(1, "order", "a", "3"), (1, "unknown", "b", "4"), (2, "unknown", None, None), (3, "unknown", None, None), (4, "unknown", None, None)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], QUOTE)
    assert health.feed_health(none, 1).count() == 0
    assert signals.residual_signals(none).count() == 0
    assert signals.impulse_signals(none).count() == 0
    assert leadlag.leadership(none, [100]).count() == 0


def greedy(rows, cooldown):
    last, out = {}, []
    for ts, row_no, key in sorted(rows, key=lambda r: (str(r[2]), r[0], r[1])):
        if key not in last or ts - last[key] >= cooldown:
            last[key] = ts
            out.append(row_no)
    return sorted(out)


@pytest.mark.parametrize(("stride", "fold", "cooldown"), [(64, 1 << 16, 10), (8, 100, 1), (8, 60, 70)])
def test_cooldown_against_loop(spark, stride, fold, cooldown):
    rng = random.Random(cooldown)
    rows, ts = [], {"a": -500, "b": 10_000, None: 0}
    for i in range(1500):
        key = rng.choice(["a", "a", "b", None])
        ts[key] += rng.choice([0, 0, 1, 1, 2, 9, 60, 900])
        rows.append((ts[key], i, key))
    df = spark.createDataFrame(rows, "ts long, row_no long, symbol string").withColumn("model", F.lit("m"))
    assert sorted(r["row_no"] for r in windows.cooldown_thin(df, cooldown, stride=stride, fold_rows=fold).collect()) == greedy(rows, cooldown)


def test_a_million_dense_candidates_of_one_key(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("row_no"), (F.col("id") * 3 % 1_000_003).alias("ts"), F.lit("S").alias("symbol"), F.lit("m").alias("model"))
    got = windows.cooldown_thin(df, 1000)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    times = sorted(k * 3 % 1_000_003 for k in range(1_000_000))
    want, last = 0, None
    for ts in times:
        if last is None or ts - last >= 1000:
            want, last = want + 1, ts
    assert got.count() == want


def test_each_source_is_read_four_times_at_most(spark, tmp_path):
    """Steps share one sort of a chunk; a plan that grows with every step would read the source again and again."""
    spark.createDataFrame(random_quotes(200, 5), QUOTE).write.parquet(str(tmp_path / "q"))
    q = spark.read.parquet(str(tmp_path / "q"))
    frames = {
        "pairs": (windows.basis_samples(q), 2), "moments": (windows.ewm_basis(windows.basis_samples(q), 7), 4), "residual": (signals.residual_frame(q, 7), 4),
        "impulse": (signals.impulse_frame(q, (5, 50)), 4), "features": (signals.feature_snapshots(q, residual_window_ms=7), 4), "signals": (signals.residual_signals(q), 0),
    }
    for name, (df, most) in frames.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len([line for line in plan.splitlines() if "FileScan" in line and str(tmp_path) in line]) <= most, name


def test_many_timelines_in_one_sort(spark):
    rows = random_quotes(300, seed=9)
    df = spark.createDataFrame(rows, QUOTE)
    left, a, b = df.where("venue = 'binance'"), df.where("venue = 'mexc'"), df.where("venue = 'mexc' AND row_no % 3 = 0")
    many = asof.asof_many(left, {"x": asof.Timeline(a, F.col("row_no")), "y": asof.Timeline(b, F.col("bid"), strict=True)}, ["symbol"], chunk_ms=50)
    one = asof.asof_backward(left, a, ["symbol"], F.col("row_no"), "x", chunk_ms=None)
    two = asof.asof_backward(one, b, ["symbol"], F.col("bid"), "y", strict=True, chunk_ms=None)
    assert sorted(map(str, many.collect())) == sorted(map(str, two.select(many.columns).collect()))


def test_last_two_values_and_positions(spark):
    rows = random_quotes(300, seed=11)
    got = {r["row_no"]: r for r in windows.pair_frame(spark.createDataFrame(rows, QUOTE), "binance", "mexc", ["row_no"]).collect()}
    last, count = {}, {}
    for i, ts, ex, v, s, *_ in sorted(rows, key=lambda r: (r[1] or r[2], r[2], r[3], r[4], r[0])):
        own = last.setdefault(s, {"binance": [], "mexc": []})
        own[v].append(i)
        for name, venue in (("leader", "binance"), ("lagger", "mexc")):
            now, before = ([None, None] + own[venue])[-1], ([None, None] + own[venue])[-2]
            assert (got[i][name] and got[i][name]["row_no"]) == now and (got[i][f"{name}_before"] and got[i][f"{name}_before"]["row_no"]) == before
        known = bool(own["binance"] and own["mexc"])
        assert got[i]["position"] == (count.get(s, 0) if known else -1)
        count[s] = count.get(s, 0) + known


def test_a_rejection_keeps_its_reason(spark):
    raw = spark.createDataFrame([(1, '{"Type":"OrderUpdate","Data":{"ClientId":"a","Status":"rejected","Reason":"no margin"}}'), (2, '{"Data":{"Orders":[{"ClientId":"b","Status":"error","message":"too small"}]}}')], "row_no long, body string")
    known = spark.createDataFrame([("a", "S", 2.0, "accepted"), ("b", "S", 2.0, "accepted")], "client_order_id string, symbol string, qty double, status string")
    updates = orders.updates_of_orders(orders.classify_private_updates(orders.expand_private_updates(raw)))
    got = {r["client_order_id"]: (r["after_status"], r["reject_reason"]) for r in orders.order_state_timeline(known, updates).collect()}
    assert got == {"a": ("rejected", "no margin"), "b": ("rejected", "too small")}


def test_entry_state_against_loop(spark):
    rng = random.Random(4)
    day = 86_400_000
    fills = [(i, rng.choice("AB"), rng.choice(["buy", "sell"]), rng.randint(1, 90), (e := rng.randrange(0, 4 * day, 1_800_000)), rng.choice([None, e + rng.randrange(0, 2 * day, 1_800_000)]), rng.randint(-9, 9)) for i in range(60)]
    intents = [(i, rng.choice("ABC"), rng.choice(["buy", "sell"]), rng.randrange(0, 6 * day, 1_800_000)) for i in range(80)]
    fdf = spark.createDataFrame(fills, "position_id long, symbol string, side string, notional int, entry_ts_ms long, exit_ts_ms long, pnl int").withColumn("notional", F.col("notional").cast("decimal(18,2)")).withColumn("realized_pnl_usd", F.col("pnl").cast("decimal(18,2)"))
    got = {r["n"]: r for r in risk.entry_state(spark.createDataFrame(intents, "n long, symbol string, side string, created_ts_ms long"), fdf).collect()}
    assert len(got) == len(intents)
    for i, s, side, ts in intents:
        live = [f for f in fills if f[4] <= ts and (f[5] is None or f[5] > ts)]
        mine = [f for f in live if f[1] == s]
        closed = [f for f in fills if f[5] is not None and f[5] <= ts and f[5] // day == ts // day]
        r = got[i]
        assert (r["open_positions"], r["active_symbols"], r["direction_count"], r["symbol_active"]) == (len(live), len({f[1] for f in live}), len([f for f in mine if f[2] == side]), bool(mine))
        assert (int(r["total_notional"]), int(r["symbol_notional"]), int(r["daily_pnl"])) == (sum(f[3] for f in live), sum(f[3] for f in mine), sum(f[6] for f in closed))


@pytest.mark.parametrize("chunk", [1, 300, 100_000])
def test_first_trade_through_against_loop(spark, chunk):
    rng = random.Random(6)
    trades = [(i, rng.randrange(0, 3000, 3), rng.choice("AB"), rng.choice([None, *range(90, 110)]), float(rng.randint(1, 5))) for i in range(400)]
    intents = [(i, rng.choice("ABC"), rng.choice(["buy", "sell"]), rng.choice([None, *(float(x) for x in range(85, 115))]), 3.0, rng.randrange(0, 3000, 3)) for i in range(300)]
    tdf = spark.createDataFrame([(i, ts, s, None if p is None else float(p), q) for i, ts, s, p, q in trades], "row_no long, local_ts_ms long, symbol string, price double, qty double")
    idf = spark.createDataFrame(intents, "intent_id long, symbol string, side string, price_cap double, qty double, created_ts_ms long")
    got = {r["intent_id"]: r for r in outcomes.first_trade_through(idf, tdf, 200, chunk_ms=chunk).collect()}
    assert len(got) == len(intents)
    for i, s, side, cap, qty, ts in intents:
        own = sorted((t[1], t[0], t[3], t[4]) for t in trades if t[2] == s and t[3] is not None and cap is not None and ts < t[1] <= ts + 200 and (t[3] <= cap if side == "buy" else t[3] >= cap))
        r = got[i]
        assert (r["filled"], r["trade_row"], r["fill_ts_ms"], r["fill_price"], r["fill_qty"]) == ((True, own[0][1], own[0][0], float(own[0][2]), min(qty, own[0][3])) if own else (False, None, None, None, None))


@pytest.mark.parametrize("chunk", [1, 200, 100_000])
def test_aligned_returns_against_loop(spark, chunk):
    rng = random.Random(8)
    rows = [(i, rng.choice("AB"), rng.choice(["binance", "mexc", "other"]), rng.randrange(0, 3000, 4), float(rng.randint(-9, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "row_no long, symbol string, venue string, ts long, ret double")
    lags = [0, 25, 110]
    got = sorted((r["symbol"], r["direction"], r["ts"], r["x"], r["lag_ms"], r["y"]) for r in leadlag.aligned_returns(df, lags, 9, chunk_ms=chunk).collect())
    want = []
    for _, s, v, ts, x in rows:
        for lag in lags if v != "other" else []:
            near = min(((t, i, y) for i, o, w, t, y in rows if o == s and w not in (v, "other") and abs(t - lag - ts) <= 9), default=None)
            want += [(s, v, ts, x, lag, near[2])] if near else []
    assert want and got == sorted(want)
    plan = leadlag.leadership_scores(spark.createDataFrame(random_quotes(50, 1), QUOTE), lags)._jdf.queryExecution().executedPlan().toString()
    more = leadlag.leadership_scores(spark.createDataFrame(random_quotes(50, 1), QUOTE), lags * 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == more.count("Exchange hashpartitioning")
