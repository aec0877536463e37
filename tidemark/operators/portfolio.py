"""Positions and closed trades of accounts: state that is checked on reading, values, statistics, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joins import sum_within

# Order states by the words that brokers use.
STATES_A = {"new": "PENDING", "accepted": "ACCEPTED", "pending_new": "PENDING", "accepted_for_processing": "ACCEPTED", "partially_filled": "PARTIAL", "filled": "FILLED", "done_for_day": "FILLED", "canceled": "CANCELLED", "expired": "EXPIRED", "replaced": "CANCELLED", "pending_cancel": "PENDING", "pending_replace": "PENDING", "stopped": "FILLED", "rejected": "REJECTED", "suspended": "REJECTED", "calculated": "PENDING"}
STATES_B = {"PendingSubmit": "PENDING", "PendingCancel": "PENDING", "PreSubmitted": "ACCEPTED", "Submitted": "ACCEPTED", "ApiPending": "PENDING", "ApiCancelled": "CANCELLED", "Cancelled": "CANCELLED", "Filled": "FILLED", "Inactive": "REJECTED"}
# What each role may do.
PERMISSIONS = {
    "VIEWER": ["VIEW_DASHBOARD", "VIEW_PORTFOLIO", "VIEW_LOGS"],
    "TRADER": ["VIEW_DASHBOARD", "VIEW_PORTFOLIO", "VIEW_LOGS", "RUN_SCAN", "TRADE"],
    "ADMIN": ["VIEW_DASHBOARD", "VIEW_PORTFOLIO", "VIEW_LOGS", "RUN_SCAN", "TRADE", "MANAGE_CONFIG", "ROTATE_KEYS", "MANAGE_USERS"],
}


def order_state(status: Column, broker: str = "a") -> Column:
    """Our state of a broker's word; unknown words are PENDING."""
    names = STATES_A if broker == "a" else STATES_B
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.lower(status) if broker == "a" else status), F.lit("PENDING"))


def allowed(users: DataFrame, permission: str) -> DataFrame:
    """Users (user, role) with a permission; unknown and missing roles are viewers."""
    role = F.when(F.col("role").isin(*PERMISSIONS), F.col("role")).otherwise("VIEWER")
    return users.where(role.isin(*[r for r, p in PERMISSIONS.items() if permission in p]))


def valid_positions(raw: DataFrame, most: float = 1e9) -> DataFrame:
    """Positions whose side is LONG or SHORT and whose amounts are numbers from 0 to `most`; amounts may come as text."""
    amounts = {c: F.col(c).cast("string").try_cast("double") for c in ("entry_price", "quantity", "current_price")}
    ok = F.col("side").isin("LONG", "SHORT")
    for c in amounts:
        ok = ok & F.col(c).between(0, most)
    return raw.withColumns(amounts).where(F.coalesce(ok, F.lit(False)))


def position_values(positions: DataFrame) -> DataFrame:
    """positions with unrealised gains, their share of cost, and whether the stop or the profit is reached."""
    sign = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    move = sign * F.try_divide(F.col("current_price") - F.col("entry_price"), F.col("entry_price"))
    df = positions.withColumns({"unrealized": sign * (F.col("current_price") - F.col("entry_price")) * F.col("quantity"), "move": move})
    return df.withColumns({"hit_stop": F.coalesce(F.col("move") <= -F.col("stop_loss"), F.lit(False)), "hit_take": F.coalesce(F.col("move") >= F.col("take_profit"), F.lit(False))})


def equity(cash: DataFrame, positions: DataFrame, accounting: str = "correct") -> DataFrame:
    """account, equity: cash and the market value of long, the gain of short positions; "reference" adds only gains to cash."""
    gain = F.col("unrealized")
    value = gain if accounting == "reference" else F.when(F.col("side") == "LONG", F.col("current_price") * F.col("quantity")).otherwise(gain)
    sums = position_values(positions).groupBy("account").agg(F.sum(value).alias("_v"))
    return cash.join(sums, "account", "left").select("account", (F.col("cash") + F.coalesce("_v", F.lit(0.0))).alias("equity"))


def closed_stats(trades: DataFrame, by: str = "account") -> DataFrame:
    """by, realised gain, win rate, Sharpe proxy (mean / deviation of returns, by the year; 0 below two trades)."""
    out = trades.groupBy(by).agg(F.count("*").alias("n"), F.sum("pnl").alias("realized"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("pnl_pct").alias("_m"), F.stddev_pop("pnl_pct").alias("_s"))
    sharpe = F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce(F.try_divide(F.col("_m"), F.col("_s")) * F.sqrt(F.lit(252.0)), F.lit(0.0)))
    return out.select(by, "n", "realized", "win_rate", sharpe.alias("sharpe"))


def quick_trade(price: Column, amount: Column, buy: Column, stop: Column, take: Column) -> Column:
    """struct<quantity, stop_price, take_price, risk, reward, ratio> of an order; stop and take are percent."""
    sign = F.when(buy, 1.0).otherwise(-1.0)
    return F.struct(
        F.coalesce(F.try_divide(amount, price), F.lit(0.0)).alias("quantity"), (price * (1 - sign * stop / 100)).alias("stop_price"), (price * (1 + sign * take / 100)).alias("take_price"),
        (amount * stop / 100).alias("risk"), (amount * take / 100).alias("reward"), F.coalesce(F.try_divide(take, stop), F.lit(0.0)).alias("ratio"),
    )


def key_expiry(issued: Column, today: Column, days: int = 90, warn: int = 7) -> Column:
    """struct<days_left, expired, alert> of a key."""
    left = days - F.datediff(today, issued)
    return F.struct(left.alias("days_left"), (left <= 0).alias("expired"), (left <= warn).alias("alert"))


def lockouts(attempts: DataFrame, by: str, most: int = 5, minutes: int = 15) -> DataFrame:
    """Attempts (by, ts, ok) with `locked`: `most` failures in the last minutes before it."""
    failed = sum_within(attempts, by, minutes * 60_000_000, (~F.col("ok")).cast("int"), itself=False)
    return failed.withColumn("locked", F.col("_within") >= most).drop("_within")


def alert_summary(history: DataFrame) -> DataFrame:
    """level, alerts, symbols, newest: an overview of an alert table."""
    return history.groupBy("level").agg(F.count("*").alias("alerts"), F.countDistinct("symbol").alias("symbols"), F.max("ts").alias("newest"))


def verified_models(models: DataFrame, registry: DataFrame) -> DataFrame:
    """Models (name, sha256) with `verified`: the registry holds the same hash of the name."""
    known = registry.select("name", F.col("sha256").alias("_known"))
    return models.join(known, "name", "left").withColumn("verified", F.coalesce(F.col("sha256") == F.col("_known"), F.lit(False))).drop("_known")


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a JSON-lines log: columns of `schema`, and lines (column `line`) that are no JSON object. Blank lines are nothing.

    A field that doesn't fit its type is null; its row stays.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("_fields", F.from_json("value", "map<string,string>"))
    rows = lines.where("_fields IS NOT NULL").select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows, lines.where("_fields IS NULL").select(F.col("value").alias("line"))


def append_log(rows: DataFrame, path: str, day: str | None = None) -> None:
    """Appends JSON lines; with `day`, in a folder for each value of that column."""
    writer = rows.write.mode("append")
    (writer.partitionBy(day) if day else writer).json(path)
