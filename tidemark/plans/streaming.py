"""Queries of streams: tables are written as files whose rows come out of order, streamed file by file, and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import alerts
from tidemark.plans.queries import _CROSS, BARS, _scratch, events_of, query, r6, scored_signals
from tidemark.sources.bars import hourly_bars
from tidemark.streaming import paper, streams

#: How far rows are out of order, and so how late they may be.
DISORDER_H, LATE = 24, "24 hours"
#: Parts of a stream, a batch each, and about how many rows a file of a part has.
PARTS, FILE_ROWS = 3, 250_000


def shuffled_stream(rows: DataFrame, root: str) -> DataFrame:
    """A stream of PARTS batches that hold all rows, dealt by time and up to DISORDER_H hours too late; within a file in the order of a hash.

    A batch takes a fixed number of files, so all parts have as many as the smallest can fill."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts") + F.pmod(F.xxhash64(*rows.columns), F.lit(DISORDER_H * 3_600_000_000))
    low, high = rows.select(F.min(at), F.max(at)).head()
    part = F.floor((at - F.lit(low or 0)) * PARTS / F.lit((high or 0) - (low or 0) + 1))
    sizes = dict(rows.groupBy(part.alias("part")).count().collect())  # PARTS rows
    files = max(1, min(sizes.get(k, 0) for k in range(PARTS)) // FILE_ROWS)
    for k in range(PARTS):
        rows.where(part == k).repartition(files).sortWithinPartitions(F.xxhash64(*rows.columns, F.lit(1))).write.mode("append").parquet(f"{root}/in")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")


def drained(stream: DataFrame, root: str) -> DataFrame:
    streams.drain(stream, f"{root}/out", f"{root}/checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


@query(f"""WITH RECURSIVE {_CROSS}, c AS (SELECT *, least(0.5 + 20 * abs((f - s) / nullif(s, 0)), 0.95) AS conf FROM g WHERE signal <> 'HOLD'),
    r(rule, ms, mc, wait) AS (VALUES ('strong_signal', 0.50, 0.40, 180000), ('critical_signal', 0.75, 0.60, 72000), ('any_signal', 0.30, 0.0, 36000)),
    a AS MATERIALIZED (SELECT symbol, rule, signal, ts, wait, row_number() OVER (PARTITION BY symbol, rule ORDER BY ts) AS k FROM c JOIN r ON conf >= ms AND conf >= mc),
    z AS (SELECT symbol, rule, signal, ts, k, ts AS kept, true AS keep FROM a WHERE k = 1 UNION ALL
        SELECT a.symbol, a.rule, a.signal, a.ts, a.k, CASE WHEN epoch(a.ts) - epoch(z.kept) >= a.wait THEN a.ts ELSE z.kept END, epoch(a.ts) - epoch(z.kept) >= a.wait FROM z JOIN a ON a.symbol = z.symbol AND a.rule = z.rule AND a.k = z.k + 1)
    SELECT symbol, CAST(ts AS VARCHAR) AS ts, rule, signal FROM z WHERE keep AND ts <= (SELECT max(ts) - INTERVAL {DISORDER_H} HOURS FROM a)""")  # fmt: skip
def stream_cooled(spark, d):
    """Alerts of a stream out of order, cooled down: those that the watermark has passed are what the batch keeps."""
    rules = alerts.default_rules(spark).withColumn("cooldown_s", F.col("cooldown_s") * 600)
    found = alerts.matches(scored_signals(spark, d), rules).select("symbol", "ts", "rule", "signal", "cooldown_s")
    root = _scratch(spark, "cooled")
    out = drained(streams.stream_cool_down(shuffled_stream(found, root), LATE, 180_000), root)
    return r6(out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "rule", "signal"))


_FILLS = "CASE WHEN event_type <> 'purchase' THEN 0.0::DOUBLE WHEN event_id % 3 = 0 THEN 2.0::DOUBLE WHEN event_id % 3 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS u, ts, value AS price, {_FILLS} AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    z AS (SELECT u, 0::BIGINT AS k, NULL::TIMESTAMP AS ts, NULL::DOUBLE AS price, 0.0::DOUBLE AS q0, NULL::DOUBLE AS en0, 0.0::DOUBLE AS closed, 0.0::DOUBLE AS q1, NULL::DOUBLE AS en1, NULL::VARCHAR AS ev FROM (SELECT DISTINCT u FROM e) UNION ALL
        SELECT u, k, ts, price, q0, en0, closed, q1, en1, CASE WHEN q1 <> 0 AND sign(q1) * (price - en1) / nullif(en1, 0) <= -0.3 THEN 'stop_loss' WHEN q1 <> 0 AND sign(q1) * (price - en1) / nullif(en1, 0) >= 0.5 THEN 'take_profit' END FROM
        (SELECT *, q0 + d AS q1, CASE WHEN q0 + d = 0 THEN NULL WHEN d = 0 THEN en0 WHEN q0 * d < 0 AND q0 * (q0 + d) > 0 THEN en0 WHEN q0 * d < 0 OR q0 = 0 THEN price ELSE (en0 * abs(q0) + price * abs(d)) / abs(q0 + d) END AS en1, CASE WHEN q0 * d < 0 THEN least(abs(q0), abs(d)) ELSE 0 END AS closed FROM
        (SELECT e.*, CASE WHEN z.ev IS NULL THEN z.q1 ELSE 0 END AS q0, CASE WHEN z.ev IS NULL THEN z.en1 END AS en0 FROM z JOIN e ON e.u = z.u AND e.k = z.k + 1))),
    o AS (SELECT u, ts, 'fill' AS event, q0 AS q, en0 AS en, price, closed AS n FROM z WHERE closed > 0 UNION ALL SELECT u, ts, ev, q1, en1, price, abs(q1) FROM z WHERE ev IS NOT NULL)
    SELECT u AS user_id, CAST(ts AS VARCHAR) AS ts, event, CASE WHEN q > 0 THEN 'LONG' ELSE 'SHORT' END AS side, round(en, 6) AS entry_price, round(price, 6) AS price, n AS quantity, round(sign(q) * (price - en) * n, 6) AS pnl
    FROM o WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) FROM events) - {DISORDER_H * 3_600_000}""")  # fmt: skip
def stream_stops(spark, d):
    """Events as ticks of a user's price, purchases as fills besides, both out of order: positions closed by fills, stops and profits."""
    root = _scratch(spark, "stops")
    source = shuffled_stream(events_of(spark, d).select("event_id", "ts", "user_id", "event_type", "value"), root)
    ticks = source.select(F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"))
    quantity = F.when(F.col("event_id") % 3 == 0, 2.0).when(F.col("event_id") % 3 == 1, -1.0).otherwise(1.0)
    fills = source.where("event_type = 'purchase'").select(F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), quantity.alias("quantity"), F.lit(0.3).alias("stop_loss"), F.lit(0.5).alias("take_profit"))
    out = drained(streams.stream_stops(fills, ticks, LATE), root)
    return r6(out.withColumnRenamed("symbol", "user_id").withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query(f"""WITH c AS (SELECT event_id, ts, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS calls FROM events)
    SELECT event_id, calls FROM c WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) FROM events) - {DISORDER_H * 3_600_000}""")
def stream_rate_limit(spark, d):
    root = _scratch(spark, "calls")
    source = shuffled_stream(events_of(spark, d).select("event_id", "ts", "event_type"), root)
    return drained(streams.stream_calls(source, "event_type", "event_id", 3600, LATE), root).withColumnRenamed("call_id", "event_id")


@query(f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY user_id, s HAVING epoch_ms(max(ts)) + 6 * 3600000 <= (SELECT epoch_ms(max(ts)) FROM events) - {DISORDER_H * 3_600_000}""")  # fmt: skip
def stream_sessions(spark, d):
    root = _scratch(spark, "sessions")
    source = shuffled_stream(events_of(spark, d).select("user_id", "ts", "value"), root)
    out = drained(streams.stream_sessions(source, "user_id", "6 hours", LATE), root)
    return out.select("user_id", F.col("start").cast("timestamp_ntz").cast("string").alias("start"), "events", F.round("value", 4).alias("value"))


#: Weekly quotes of every symbol, and what three accounts decide on each.
_WEEKS = f"""{BARS}, q AS MATERIALIZED (SELECT symbol, dense_rank() OVER (ORDER BY date_trunc('week', ts)) AS scan, arg_min(open, ts) AS o, arg_max(close, ts) AS price FROM bars GROUP BY symbol, date_trunc('week', ts)),
    d AS MATERIALIZED (SELECT scan, symbol, price, account, CASE account WHEN 'trend' THEN CASE WHEN price > o THEN 'BUY' ELSE 'SELL' END WHEN 'contra' THEN CASE WHEN price > o THEN 'SELL' ELSE 'BUY' END ELSE 'BUY' END AS action, (scan + length(symbol)) % 4 <> 0 AS approved, size, cash AS cash_0
        FROM q, (VALUES ('trend', 0.05::DOUBLE, 100000.0::DOUBLE), ('contra', 0.15::DOUBLE, 200000.0::DOUBLE), ('mixed', 0.08::DOUBLE, 50000.0::DOUBLE)) t(account, size, cash))"""
_HELD = "side IS NOT NULL AND event IS NULL"


@query(f"""WITH RECURSIVE {_WEEKS}, z AS (
        SELECT 0::BIGINT AS scan, account, symbol, NULL::VARCHAR AS side, NULL::DOUBLE AS entry, NULL::DOUBLE AS q, any_value(cash_0) AS cash, any_value(cash_0) AS peak, NULL::VARCHAR AS event, NULL::VARCHAR AS side_0, NULL::DOUBLE AS q_0, NULL::DOUBLE AS pnl, NULL::DOUBLE AS opened, NULL::DOUBLE AS price FROM d GROUP BY account, symbol UNION ALL
        SELECT scan, account, symbol, CASE WHEN value > 0 THEN CASE action WHEN 'BUY' THEN 'LONG' ELSE 'SHORT' END WHEN event IS NULL THEN side END, CASE WHEN value > 0 THEN price WHEN event IS NULL THEN entry END, CASE WHEN value > 0 THEN value / price WHEN event IS NULL THEN q END,
            cash1 - sum(CASE WHEN value > 0 AND action = 'BUY' THEN value ELSE 0 END) OVER (PARTITION BY account), greatest(peak, equity), event, side, q, pnl, CASE WHEN value > 0 THEN value / price END, price FROM
        (SELECT *, CASE WHEN wanted THEN cash1 * exp(coalesce(sum(CASE WHEN wanted AND action = 'BUY' THEN ln(1 - share) ELSE 0 END) OVER (PARTITION BY account ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * share END AS value FROM
        (SELECT *, NOT ({_HELD}) AND approved AND price > 0 AND coalesce((peak - equity) / nullif(peak, 0) <= 0.15, true) AS wanted, least(size, 0.10) AS share FROM
        (SELECT *, cash1 + sum(CASE WHEN {_HELD} THEN worth ELSE 0 END) OVER (PARTITION BY account) AS equity FROM
        (SELECT *, cash + sum(CASE WHEN event IS NOT NULL THEN worth ELSE 0 END) OVER (PARTITION BY account) AS cash1 FROM
        (SELECT *, CASE WHEN move <= -0.1 THEN 'stop_loss' WHEN move >= 0.2 THEN 'take_profit' END AS event, CASE side WHEN 'LONG' THEN coalesce(price, entry) * q WHEN 'SHORT' THEN coalesce(pnl, 0) END AS worth FROM
        (SELECT z.scan + 1 AS scan, z.account, z.symbol, z.side, z.entry, z.q, z.cash, z.peak, n.price, n.action, coalesce(n.approved, false) AS approved, n.size, CASE z.side WHEN 'LONG' THEN 1 ELSE -1 END * (n.price - z.entry) * z.q AS pnl, CASE z.side WHEN 'LONG' THEN 1 ELSE -1 END * (n.price - z.entry) / nullif(z.entry, 0) AS move
            FROM z LEFT JOIN d n ON n.account = z.account AND n.symbol = z.symbol AND n.scan = z.scan + 1 WHERE z.scan < (SELECT max(scan) FROM q))))))))
    SELECT scan, account, symbol, event, side_0 AS side, round(price, 4) AS price, round(q_0, 4) AS quantity, round(pnl, 4) AS pnl FROM z WHERE event IS NOT NULL
    UNION ALL SELECT scan, account, symbol, 'open', side, round(price, 4), round(opened, 4), 0.0 FROM z WHERE opened IS NOT NULL""")  # fmt: skip
def desk_paper_chain(spark, d):
    """Weekly scans of three accounts as a stream, each scan from the state that the one before committed: all trades."""
    weeks = hourly_bars(spark, d).groupBy("symbol", F.date_trunc("week", "ts").alias("week")).agg(F.min_by("open", "ts").alias("o"), F.max_by("close", "ts").alias("price"))
    named = weeks.select("week").distinct().orderBy("week").collect()  # a scan is a week
    scan = F.element_at(F.create_map(*(F.lit(x) for k, r in enumerate(named, 1) for x in (r.week, k))), F.col("week")).cast("long")
    quotes = weeks.select(scan.alias("scan"), "symbol", "price", "o")
    accounts = spark.createDataFrame([("trend", 0.05, 100_000.0), ("contra", 0.15, 200_000.0), ("mixed", 0.08, 50_000.0)], "account string, position_size double, cash double")
    up = F.col("price") > F.col("o")
    action = F.when((F.col("account") == "mixed") | (up & (F.col("account") == "trend")) | (~up & (F.col("account") == "contra")), "BUY").otherwise("SELL")
    decisions = quotes.crossJoin(F.broadcast(accounts)).select("scan", "symbol", F.lit(None).cast("double").alias("price"), "account", action.alias("action"), ((F.col("scan") + F.length("symbol")) % 4 != 0).alias("approved"), "position_size", F.lit(0.1).alias("stop_loss"), F.lit(0.2).alias("take_profit"))  # three rows
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (part.split() for part in paper.SCANS.split(", ")[3:])]
    rows = quotes.select("scan", "symbol", "price", *nothing).unionByName(decisions)
    root = _scratch(spark, "desk")
    for k in range(1, len(named) + 1):  # a file for each scan, in their order
        rows.where(F.col("scan") == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    desk = paper.PaperDesk(accounts.select("account", "cash", F.col("cash").alias("peak")), f"{root}/desk")
    paper.stream_scans(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), desk, f"{root}/checkpoint")
    out = desk.trades()
    return out.select("scan", "account", "symbol", "event", "side", *(F.round(c, 4).alias(c) for c in ("price", "quantity", "pnl")))
