"""Which venue leads, at which lag, and how candidate lags fare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import LAGGER, LEADER
from tickloom.operators.asof import DAY_MS
from tickloom.operators.windows import midpoint_returns


def aligned_returns(returns: DataFrame, lags_ms: list[int], tolerance_ms: int, chunk_ms: int = DAY_MS) -> DataFrame:
    """symbol, direction (the venue taken as leader), lag_index, lag_ms, x and y: leader and shifted lagger returns that meet.

    y is the other venue's first return within the tolerance of lag_ms later. All lags are frames over one sort of a symbol's
    returns, so what is shuffled does not grow with their number. A chunk of time gets the returns in reach of it too.

    Time runs backwards in the sort, and a frame holds all that is at or after the start of the tolerance: it only grows, so
    its least item is kept up to date in one step a return, however dense returns are. That item counts if it is in time.
    """
    reach = max(lags_ms) + tolerance_ms
    back = max(0, tolerance_ms - min(lags_ms))
    chunk_ms = max(chunk_ms, reach + 1, back + 1)
    home = F.floor(F.col("ts") / chunk_ms)
    early = F.when(F.col("ts") <= home * chunk_ms + reach, home - 1)  # in reach of the chunk before
    late = F.when(F.col("ts") >= (home + 1) * chunk_ms - back, home + 1)
    own = returns.where(F.col("venue").isin(LEADER, LAGGER)).withColumn("_home", home).withColumn("_chunk", F.explode(F.array_compact(F.array(home, early, late))))
    item, stream = F.struct("ts", "row_no", "ret"), Window.partitionBy("symbol", "_chunk").orderBy("_back")

    def first(venue: str, lag: int) -> Column:
        return F.min(F.when(F.col("venue") == venue, item)).over(stream.rangeBetween(Window.unboundedPreceding, tolerance_ms - lag))

    def met(i: int, lag: int) -> Column:
        near = F.when(F.col("direction") == LEADER, F.col(f"_lagger_{i}")).otherwise(F.col(f"_leader_{i}"))
        return F.struct(F.lit(i).alias("lag_index"), F.lit(lag).cast("long").alias("lag_ms"), F.when(near["ts"] <= F.col("ts") + lag + tolerance_ms, near["ret"]).alias("y"))

    own = own.withColumn("_back", -F.col("ts"))
    firsts = (first(venue, lag).alias(f"_{name}_{i}") for i, lag in enumerate(lags_ms) for name, venue in (("leader", LEADER), ("lagger", LAGGER)))
    own = own.select("symbol", F.col("venue").alias("direction"), "ts", F.col("ret").alias("x"), "_home", "_chunk", *firsts).where("_home = _chunk")
    own = own.select("symbol", "direction", "ts", "x", F.explode(F.array(*(met(i, lag) for i, lag in enumerate(lags_ms)))).alias("_lag"))
    return own.select("symbol", "direction", "_lag.lag_index", "_lag.lag_ms", "ts", "x", "_lag.y").where("y IS NOT NULL")


def leadership_scores(quotes: DataFrame, lags_ms: list[int], tolerance_ms: int = 5, min_pairs: int = 5) -> DataFrame:
    """symbol, direction, lag_index, lag_ms, pairs, correlation, sign_agreement and score; lags with too few pairs leave."""
    pairs = aligned_returns(midpoint_returns(quotes), lags_ms, tolerance_ms)
    spread = F.sqrt(F.var_pop("x") * F.var_pop("y"))
    # correlation by hand: the built-in one fails on a constant series
    corr = F.when(F.count("*") < 2, 0.0).otherwise(F.coalesce(F.try_divide(F.covar_pop("x", "y"), spread), F.lit(0.0)))
    usable = (F.col("x") != 0) & (F.col("y") != 0)
    sign = F.coalesce(F.try_divide(F.count_if(usable & ((F.col("x") > 0) == (F.col("y") > 0))).cast("double"), F.count_if(usable)), F.lit(0.0))
    own = pairs.groupBy("symbol", "direction", "lag_index", "lag_ms").agg(F.count("*").alias("pairs"), corr.alias("correlation"), sign.alias("sign_agreement")).where(F.col("pairs") >= min_pairs)
    return own.withColumn("score", 0.7 * F.greatest(F.lit(0.0), "correlation") + 0.3 * F.col("sign_agreement"))


def leadership(quotes: DataFrame, lags_ms: list[int], tolerance_ms: int = 5, min_pairs: int = 5, min_score: float = 0.55) -> DataFrame:
    """Leader, lagger, lag and reason of each symbol.

    The best lag is that of the highest (score, pairs), ties to the first. The usual leader wins only with a strictly
    higher score than the other direction. Under min_score nobody leads.
    """
    scores = leadership_scores(quotes, lags_ms, tolerance_ms, min_pairs)
    rank = F.struct(F.col("score"), F.col("pairs"), -F.col("lag_index"))
    best = scores.groupBy("symbol", "direction").agg(F.max_by(F.struct("score", "lag_ms"), rank).alias("b"))
    pick = lambda v: F.max(F.when(F.col("direction") == v, F.col("b")))
    best = best.groupBy("symbol").agg(pick(LEADER).alias("p"), pick(LAGGER).alias("q"))
    mids = quotes.where("bid + ask > 0").groupBy("symbol").agg(F.count_if(F.col("venue") == LEADER).alias("n_p"), F.count_if(F.col("venue") == LAGGER).alias("n_q"))
    own = quotes.select("symbol").distinct().join(mids, "symbol", "left").join(best, "symbol", "left")
    first = F.col("p").isNotNull() & (F.col("q").isNull() | (F.col("p.score") > F.col("q.score")))
    few = F.coalesce((F.col("n_p") < 2) | (F.col("n_q") < 2), F.lit(True))
    own = own.withColumn("w", F.when(first, F.col("p")).otherwise(F.col("q"))).withColumn("first", first)
    reason = F.when(few, "insufficient_samples").when(F.col("w").isNull(), "insufficient_pairs").when(F.col("w.score") < min_score, "unstable").otherwise("ok")
    own = own.withColumn("reason", reason)
    ok = F.col("reason") == "ok"
    return own.select(
        "symbol", F.when(ok, F.when(F.col("first"), LEADER).otherwise(LAGGER)).alias("leader"), F.when(ok, F.when(F.col("first"), LAGGER).otherwise(LEADER)).alias("lagger"),
        F.when(few | F.col("w").isNull(), 0.0).otherwise(F.col("w.score")).alias("leader_score"), F.when(~few, F.col("w.lag_ms")).alias("lag_ms"), "reason", (ok & (F.col("w.score") > 0)).alias("stable"),
    )


def lag_candidate_stats(observations: DataFrame, lags_ms: list[int]) -> DataFrame:
    """samples, hits, hit_rate, residual_variance (mean square) and paper_pnl_usd by symbol and lag; other lags are an error."""
    known = F.when(F.col("lag_ms").isin(lags_ms), F.col("lag_ms")).otherwise(F.raise_error(F.concat(F.lit("unsupported lag "), F.col("lag_ms").cast("string"))))
    hit = (F.signum("predicted_move_bps") * F.signum("actual_move_bps")) > 0
    off = F.col("actual_move_bps") - F.col("predicted_move_bps")
    own = observations.withColumn("lag_ms", known.cast("long")).groupBy("symbol", "lag_ms")
    return own.agg(F.count("*").alias("samples"), F.count_if(hit).alias("hits"), (F.count_if(hit) / F.count("*")).alias("hit_rate"), F.avg(off * off).alias("residual_variance"), F.sum("paper_pnl_usd").alias("paper_pnl_usd"))


def lag_selection(stats: DataFrame, min_samples: int = 10, pnl_weight: float = 1.0, residual_penalty: float = 1.0) -> DataFrame:
    """Best lag of each symbol: score 100 * hit rate + weighted pnl - penalised residual variance, ties to the smaller lag."""
    score = 100 * F.col("hit_rate") + pnl_weight * F.col("paper_pnl_usd") - residual_penalty * F.col("residual_variance")
    own = stats.withColumn("score", score).withColumn("enough", F.col("samples") >= min_samples)
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("enough").desc(), F.col("score").desc(), F.col("lag_ms").asc()))
    best = own.withColumn("rank", rank).where("rank = 1")
    keep = lambda c: F.when(F.col("enough"), F.col(c)).alias(c)
    return best.select("symbol", keep("lag_ms"), F.when(F.col("enough"), "ok").otherwise("insufficient_samples").alias("reason"), keep("score"))
