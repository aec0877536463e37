"""The same operators on streams: bars and sessions with a watermark, cooldowns, positions, stops and call counts as state per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.streaming.ordered import PROVIDER, Calls, Cooldown, Positions, Stops, in_order


def stream_bars(ticks: DataFrame, symbol: Column, price: Column, order: list[str], every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks (time in `ts`); rows later than `late` are dropped, a bar is sent when it can't change any more."""
    keyed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).select("ts", symbol.alias("symbol"), price.cast("double").alias("price"), F.struct(*order).alias("at"))
    bars = keyed.withWatermark("ts", late).groupBy(F.window("ts", every), "symbol")
    out = bars.agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def stream_cool_down(found: DataFrame, late: str = "10 minutes", longest_s: int = 86_400) -> DataFrame:
    """rule, symbol, ts, signal of alerts (rule, symbol, ts, signal, cooldown_s) at least their cooldown after the last one kept.

    Rows may come in any order within `late`; the result is that of `alerts.cool_down` over rows that the watermark has passed. No
    cooldown is longer than `longest_s`; a key without alerts for so long has no state.
    """
    kept = in_order(found.withColumn("cooldown_s", F.col("cooldown_s").cast("long")), ["rule", "symbol"], Cooldown(longest_s), late)
    return kept.select("rule", "symbol", F.timestamp_micros("at").alias("ts"), "signal")


def stream_positions(fills: DataFrame, late: str = "10 minutes") -> DataFrame:
    """symbol, ts, quantity, cost, realised: the position after each fill (symbol, ts, seq, quantity signed, price)."""
    fills = fills.withColumns({"seq": F.col("seq").cast("long"), "quantity": F.col("quantity").cast("double"), "price": F.col("price").cast("double")})
    return in_order(fills, ["symbol"], Positions(), late).select("symbol", F.timestamp_micros("at").alias("ts"), "quantity", "cost", "realised")


def fills_and_ticks(fills: DataFrame, ticks: DataFrame) -> DataFrame:
    """One stream or table of fills (symbol, ts, seq, price, quantity, stop_loss, take_profit) and ticks (symbol, ts, seq, price); at one seq the fill comes first."""
    nothing = {c: F.lit(None).cast("double") for c in ("quantity", "stop_loss", "take_profit")}
    columns = ["symbol", "ts", "seq", "kind", "price", "quantity", "stop_loss", "take_profit"]
    f = fills.withColumns({"kind": F.lit("fill"), "seq": 2 * F.col("seq").cast("long")})
    t = ticks.withColumns({"kind": F.lit("tick"), "seq": 2 * F.col("seq").cast("long") + 1} | nothing)
    doubles = ["price", "quantity", "stop_loss", "take_profit"]
    return f.select(columns).unionByName(t.select(columns)).withColumns({c: F.col(c).cast("double") for c in doubles})


def stream_stops(fills: DataFrame, ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """symbol, ts, event, side, entry_price, price, quantity, pnl: every close of a position, by a fill or by a tick that reaches its stop or profit.

    Two streams; each key's rows are taken in the order of time and seq once the watermark has passed them.
    """
    return in_order(fills_and_ticks(fills, ticks), ["symbol"], Stops(), late).select("symbol", F.timestamp_micros("at").alias("ts"), "event", "side", "entry_price", "price", "quantity", "pnl")


def stream_calls(events: DataFrame, by: str, call_id: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """call_id, calls: events of the key in the last `seconds` before each event, itself included; what `joins.calls_within` counts."""
    return in_order(events.select(by, "ts", F.col(call_id).cast("long").alias("call_id")), [by], Calls(seconds), late).select("call_id", "calls")


def stream_sessions(events: DataFrame, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """by, start, events, value: sessions as of `joins.sessions`, each sent once the watermark has passed its end."""
    keyed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = keyed.groupBy(by, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return grouped.select(by, F.col("s.start").alias("start"), "events", "value")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there and appends the result to Parquet; its state is kept in RocksDB."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, PROVIDER)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(name, before) if before else conf.unset(name)
    query.awaitTermination()
