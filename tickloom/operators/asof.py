"""Event-time as-of joins.

All are unions with a running last value. A key's rows are split into chunks of time, of a day unless told
otherwise: their windows run in parallel and the last value of earlier chunks is carried in from one small
aggregate. So a key that holds a third of all rows is spread over many tasks, and a gap of any length is
still bridged. With chunk_ms=None a key is one window, which reads a small input once instead of twice.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS, DAY_MS = 3_600_000, 86_400_000


def running_last(df: DataFrame, keys: list[str], ts: str, order: list[Column], values: dict[str, Column], current: bool = True, chunk_ms: int | None = DAY_MS) -> DataFrame:
    """df with the last non-null value of each expression up to each row (before it, if not current), by key.

    order is the total order of a key's rows and begins with ts, which must not be null.
    """
    if chunk_ms is None:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
        return df.select(*(c for c in df.columns if c not in values), *(F.last(v, True).over(frame).alias(n) for n, v in values.items()))
    df = df.withColumn("_chunk", F.floor(F.col(ts) / chunk_ms))
    place = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    ends = df.groupBy(*keys, "_chunk").agg(*(F.max_by(v, F.when(v.isNotNull(), place)).alias(f"_end_{n}") for n, v in values.items()))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_chunk", *(F.last(f"_end_{n}", True).over(before).alias(f"_in_{n}") for n in values))
    own = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    inner = df.select("*", *(F.last(v, True).over(own).alias(f"_own_{n}") for n, v in values.items()))
    out = inner.join(carried, [*keys, "_chunk"])
    return out.select(*(c for c in df.columns if c not in (*values, "_chunk")), *(F.coalesce(f"_own_{n}", f"_in_{n}").alias(n) for n in values))


def running_two(df: DataFrame, keys: list[str], ts: str, order: list[Column], values: dict[str, Column], last_only: dict[str, Column] | None = None, counted: Column | None = None, chunk_ms: int = DAY_MS) -> DataFrame:
    """df with the last non-null value of each expression up to each row, and as <name>_before the non-null value before that one.

    Of last_only there are last values alone. With counted, position is the number of earlier rows for which it holds
    and all values are known, or -1 on rows of which that is not true. One sort of each chunk serves all of this; what earlier
    chunks hand on comes from one aggregate of the same sorted rows. A chunk counts its rows for every set of values
    that may have been known before it, since only the chunks before tell which were.
    """
    last_only, sets = last_only or {}, [c for k in range(len(values) + 1) for c in combinations(values, k)] if counted is not None else []
    df = df.withColumn("_chunk", F.floor(F.col(ts) / chunk_ms))
    chunk = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    until, before = chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow), chunk.rowsBetween(Window.unboundedPreceding, -1)
    own = df.select("*", *(F.last(v, True).over(before).alias(f"_prev_{n}") for n, v in values.items()), *(F.last(v, True).over(until).alias(f"_own_{n}") for n, v in last_only.items()))
    own = own.select("*", *(F.last(F.when(v.isNotNull(), F.struct(v.alias("now"), F.col(f"_prev_{n}").alias("prev"))), True).over(until).alias(f"_own_{n}") for n, v in values.items()))
    mark = "_n_{}".format
    for k, known in enumerate(sets):  # rows that count if these are known from before
        need = counted
        for n in values:
            need = need if n in known else need & F.col(f"_own_{n}").isNotNull()
        own = own.withColumn(mark(k), F.when(need, 1).otherwise(0))
    place = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    ends = own.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(*(f"_own_{n}" for n in (*values, *last_only))), place).alias("_end"), *(F.sum(mark(k)).alias(mark(k)) for k in range(len(sets))))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    filled = ends.select("*", *(F.last(f"_end._own_{n}.now", True).over(earlier).alias(f"_past_{n}") for n in values))
    two = {n: F.when(F.col(f"_end._own_{n}").isNotNull(), F.struct(F.col(f"_end._own_{n}.now").alias("now"), F.coalesce(f"_end._own_{n}.prev", f"_past_{n}").alias("prev"))) for n in values}
    filled = filled.select("*", *(F.last(v, True).over(earlier).alias(f"_in_{n}") for n, v in two.items()), *(F.last(f"_end._own_{n}", True).over(earlier).alias(f"_in_{n}") for n in last_only))
    chosen = lambda column: F.coalesce(*(F.when(_all_known(known), column(k)) for k, known in reversed(list(enumerate(sets)))))
    if sets:
        filled = filled.withColumn("_base", F.coalesce(F.sum(chosen(lambda k: F.col(mark(k)))).over(earlier), F.lit(0)))
        own = own.select("*", *(F.sum(mark(k)).over(until).alias(f"_c_{k}") for k in range(len(sets))))
    carried = filled.select(*keys, "_chunk", *(f"_in_{n}" for n in (*values, *last_only)), *(["_base"] if sets else []))
    out = own.join(carried, [*keys, "_chunk"])
    columns = [c for c in df.columns if c != "_chunk" and c not in (*values, *last_only)]
    for n in values:
        here = F.col(f"_own_{n}").isNotNull()
        columns += [F.coalesce(f"_own_{n}.now", f"_in_{n}.now").alias(n), F.when(here, F.coalesce(f"_own_{n}.prev", f"_in_{n}.now")).otherwise(F.col(f"_in_{n}.prev")).alias(f"{n}_before")]
    if sets:
        columns.append(F.when(chosen(lambda k: F.col(mark(k))) == 1, F.col("_base") + chosen(lambda k: F.col(f"_c_{k}")) - 1).otherwise(-1).cast("long").alias("position"))
    return out.select(*columns, *(F.coalesce(f"_own_{n}", f"_in_{n}").alias(n) for n in last_only))


def _all_known(names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"_in_{n}").isNotNull()
    return out


@dataclass(frozen=True)
class Timeline:
    """Values in time that other rows look up: of rows at one time the last by order counts; a strict one is seen only by later rows."""

    rows: DataFrame
    value: Column
    ts: str = "local_ts_ms"
    order: tuple[str, ...] = ("row_no",)
    strict: bool = False


def merged(left: DataFrame, rights: dict[str, Timeline], keys: list[str], left_ts: str | Column, left_order: list[Column] | None = None) -> tuple[DataFrame, list[Column], dict[str, Column]]:
    """left and any number of timelines as one union, the order to sort it by, and the value of each timeline.

    Rows of left have _side 1; their further order is left_order, whose columns other rows lack.
    """
    ts = F.col(left_ts) if isinstance(left_ts, str) else left_ts
    both = left.select("*", ts.alias("_t"), F.lit(1).alias("_side"))
    for n, right in rights.items():
        tie = F.struct(*(F.col(c) for c in right.order)).alias(f"_tie_{n}")
        rows = right.rows.select(*keys, F.col(right.ts).alias("_t"), F.lit(2 if right.strict else 0).alias("_side"), tie, right.value.alias(f"_v_{n}"))
        both = both.unionByName(rows, allowMissingColumns=True)
    order = [F.col("_t"), F.col("_side"), *(F.col(f"_tie_{n}") for n in rights), *(left_order or [])]
    return both.where("_t IS NOT NULL"), order, {n: F.col(f"_v_{n}") for n in rights}


def asof_many(left: DataFrame, rights: dict[str, Timeline], keys: list[str], left_ts: str | Column = "local_ts_ms", chunk_ms: int | None = DAY_MS) -> DataFrame:
    """left with the latest value of every timeline at or before left_ts (before it, if strict): one union and one sort for all of them.

    Rows of left without a time leave.
    """
    both, order, values = merged(left, rights, keys, left_ts)
    out = running_last(both, keys, "_t", order, values, chunk_ms=chunk_ms)
    return out.where("_side = 1").select(*(c for c in left.columns if c not in rights), *rights)


def asof_backward(
    left: DataFrame, right: DataFrame, keys: list[str], value: Column, name: str, left_ts: str | Column = "local_ts_ms", right_ts: str | Column = "local_ts_ms", right_order: list[str] | None = None, strict: bool = False, chunk_ms: int | None = DAY_MS
) -> DataFrame:
    """left with the value of the latest right row at or before left_ts (before it, if strict), null if there is none.

    Of right rows at one time the last by right_order counts.
    """
    return _asof(left, right, keys, value, name, left_ts, right_ts, right_order or ["row_no"], -1 if strict else 1, False, chunk_ms)


def asof_forward(
    left: DataFrame, right: DataFrame, keys: list[str], value: Column, name: str, left_ts: str | Column = "local_ts_ms", right_ts: str | Column = "local_ts_ms", right_order: list[str] | None = None, strict: bool = False, chunk_ms: int | None = DAY_MS
) -> DataFrame:
    """left with the value of the earliest right row at or after left_ts (after it, if strict), null if there is none."""
    return _asof(left, right, keys, value, name, left_ts, right_ts, right_order or ["row_no"], -1 if strict else 1, True, chunk_ms)


def _asof(left, right, keys, value, name, left_ts, right_ts, right_order, side, forward, chunk_ms) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    sign = -1 if forward else 1  # a descending order keeps the frame running: following frames are quadratic
    kept = [c for c in left.columns if c != name]
    lefts = left.select(*kept, (sign * col(left_ts)).alias("_t"), F.lit(side).alias("_side")).where("_t IS NOT NULL")
    tie = F.struct(*(F.col(c) for c in right_order)).alias("_tie")
    rights = right.select(*keys, (sign * col(right_ts)).alias("_t"), F.lit(0).alias("_side"), tie, value.alias("_value")).where("_t IS NOT NULL AND _value IS NOT NULL")
    both = lefts.unionByName(rights, allowMissingColumns=True)
    order = [F.col("_t"), F.col("_side"), F.col("_tie").desc() if forward else F.col("_tie")]
    if chunk_ms is None:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return both.withColumn(name, F.last("_value", True).over(frame)).where("_side <> 0").select(*kept, name)
    # the value that a chunk hands on is its last in running order
    chunk = F.floor(F.col("_t") / chunk_ms)
    rank = F.struct((-F.col("_t")).alias("t"), F.col("_tie")) if forward else F.struct(F.col("_t").alias("t"), F.col("_tie"))
    ends = rights.groupBy(*keys, chunk.alias("_chunk")).agg((F.min_by if forward else F.max_by)("_value", rank).alias("_end"))
    chunked = both.withColumn("_chunk", chunk)
    spots = chunked.select(*keys, "_chunk").distinct().join(ends, [*keys, "_chunk"], "left")
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.select(*keys, "_chunk", F.last("_end", True).over(before).alias("_in"))
    own = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = chunked.withColumn("_own", F.last("_value", True).over(own)).where("_side <> 0").join(carried, [*keys, "_chunk"])
    return inner.select(*kept, F.coalesce("_own", "_in").alias(name))


def latest_pair(quotes: DataFrame, leader: str, lagger: str, order: list[Column], columns: list[str]) -> DataFrame:
    """Each tick of either venue with the latest quote of both, itself included, as structs `leader` and `lagger`."""
    own = F.struct(*columns)
    values = {"leader": F.when(F.col("venue") == leader, own), "lagger": F.when(F.col("venue") == lagger, own)}
    return running_last(quotes.where(F.col("venue").isin(leader, lagger)), ["symbol"], "local_ts_ms", order, values)


def asof_lookback(quotes: DataFrame, windows_ms: dict[str, int], value: Column, keys: list[str] | None = None, chunk_ms: int = DAY_MS) -> DataFrame:
    """Each row with its own stream's value at or before local_ts_ms - window, for each named window; of rows at one time the last by arrival.

    All windows share one sort: range frames from the start of a chunk stay linear. A chunk gets the rows of the
    longest window before it as well, and from one small aggregate the last row before those.
    """
    keys, most = keys or ["symbol", "venue"], max(windows_ms.values())
    chunk_ms = max(chunk_ms, most)
    row = F.struct("local_ts_ms", "row_no", value.alias("v"))
    home = F.floor(F.col("local_ts_ms") / chunk_ms)
    late = F.col("local_ts_ms") >= (home + 1) * chunk_ms - most  # in reach of the next chunk
    ends = quotes.groupBy(*keys, home.alias("_chunk")).agg(F.max(row).alias("_all"), F.max(F.when(~late, row)).alias("_early"))
    stream = Window.partitionBy(*keys).orderBy("_chunk")
    ends = ends.withColumn("_past", F.max("_all").over(stream.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("_last", F.lag(F.struct("_chunk", "_early", "_past")).over(stream))
    adjacent = F.col("_last._chunk") == F.col("_chunk") - 1
    carried = ends.select(*keys, "_chunk", F.when(adjacent, F.coalesce("_last._early", "_last._past")).otherwise(F.col("_past")).alias("_in"))
    spread = quotes.withColumn("_home", home).withColumn("_chunk", F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home))))
    own = Window.partitionBy(*keys, "_chunk").orderBy("local_ts_ms")
    found = spread.select("*", *(F.max(row).over(own.rangeBetween(Window.unboundedPreceding, -w)).alias(f"_own_{n}") for n, w in windows_ms.items())).where("_home = _chunk")
    return found.join(carried, [*keys, "_chunk"]).select(*quotes.columns, *(F.coalesce(f"_own_{n}", "_in")["v"].alias(n) for n in windows_ms))


def asof_tolerance(left: DataFrame, right: DataFrame, keys: list[str], value: Column, name: str, tolerance_ms: int, right_order: list[str] | None = None, chunk_ms: int | None = DAY_MS) -> DataFrame:
    """Each left row with the earliest right row at or after left - tolerance, kept only if within the tolerance.

    The rows have a column ts. A right row serves any number of left rows.
    """
    found = F.struct(F.col("ts").alias("ts"), value.alias("v"))
    out = asof_forward(left, right, keys, found, "_near", left_ts=F.col("ts") - tolerance_ms, right_ts="ts", right_order=right_order or ["row_no"], chunk_ms=chunk_ms)
    near = F.abs(F.col("_near.ts") - F.col("ts")) <= tolerance_ms
    return out.withColumn(name, F.when(near, F.col("_near.v"))).drop("_near")
