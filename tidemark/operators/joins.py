"""Join-shaped dataflows over bars and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, columns: list[str], prefix: str = "daily_", by: str = "symbol", available: Column | None = None) -> DataFrame:
    """left (by, ts, ...) with the newest right row's columns at or before its ts; `available`: when a right row is known, its ts if not given.

    One union and one window: rows of both sides are shuffled once, by symbol.
    """
    payload = F.struct(*columns)
    r = right.select(by, (F.col("ts") if available is None else available).alias("ts"), F.lit(0).alias("_side"), payload.alias("_right"))
    l = left.select(by, "ts", F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return found.select("_left.*", *(F.col(f"_found.{c}").alias(prefix + c) for c in columns))


def daily_onto(bars: DataFrame, daily: DataFrame, columns: list[str], same_day: bool = False) -> DataFrame:
    """Bars with the features of the last finished day; `same_day` hands out those of the day that is still open."""
    return asof(bars, daily, columns, available=F.col("ts") if same_day else (F.col("ts") + F.expr("interval 1 day")))


def sum_within(rows: DataFrame, by: str, micros: int, weight: Column, itself: bool) -> DataFrame:
    """rows (by, ts) with `_within`: the sum of a whole `weight` over rows of the key in the last `micros` before each, its own instant too if `itself`.

    Time is cut into spans of that length. A row stands in its own span, where it adds its weight, and in the next, where it takes the
    weight away once it is too old; so one running sum over a span of a key tells all, a task has two spans at a time and the work
    grows as the rows do, however many are in a span. Rows without a time are alike and only see each other.
    """
    at, span = F.unix_micros(F.col("ts").cast("timestamp")), F.col("_span")
    own = rows.withColumns({"_at": at, "_weight": F.coalesce(weight.cast("long"), F.lit(0))}).withColumns({"_span": F.floor(F.col("_at") / micros), "_row": F.struct(*rows.columns)}).select(F.col(by).alias("_by"), "_at", "_weight", "_span", "_row")
    old = own.where("_at IS NOT NULL AND _weight <> 0").select("_by", (F.col("_at") + micros).alias("_at"), "_weight", (span + 1).alias("_span"))
    # at one instant rows come before those that are then too old: these are counted still
    placed = own.withColumns({"_at": 2 * F.col("_at"), "_change": F.col("_weight"), "_held": F.lit(0).cast("long")}).unionByName(old.withColumns({"_at": 2 * F.col("_at") + 1, "_change": -F.col("_weight"), "_held": F.col("_weight")}), allowMissingColumns=True)
    w = Window.partitionBy("_by", "_span")
    so_far = F.sum("_change").over(w.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0 if itself else -1))
    return placed.select("_row", (F.coalesce(so_far, F.lit(0)) + F.sum("_held").over(w)).alias("_within")).where("_row IS NOT NULL").select("_row.*", "_within")


def calls_within(events: DataFrame, by: str, seconds: int) -> DataFrame:
    """events (by, ts) with `calls`: events of the same key in the last `seconds`, itself included."""
    return sum_within(events, by, seconds * 1_000_000, F.lit(1), itself=True).withColumnRenamed("_within", "calls")


def sessions(events: DataFrame, by: str, gap: str = "30 minutes") -> DataFrame:
    """(by, start, events, value): runs of events with less than `gap` between them."""
    return events.groupBy(by, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(by, F.col("s.start").alias("start"), "events", "value")


def grid(symbols: DataFrame, strategies: DataFrame) -> DataFrame:
    """Every symbol with every strategy; both are short lists of names."""
    return symbols.select("symbol").distinct().crossJoin(strategies.select("strategy").distinct())
