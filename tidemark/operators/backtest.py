"""Backtests: one ordered fold per (symbol, strategy) for what depends on its own past, expressions for all the rest."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

RUN = ["symbol", "strategy"]
#: Bars a year by timeframe, and the hours below which a median spacing counts as it (fixed values).
BARS_A_YEAR = {"1m": 98280.0, "5m": 19656.0, "15m": 6552.0, "1h": 1638.0, "4h": 409.5, "1d": 252.0, "1wk": 52.0, "1mo": 12.0}
SPACINGS = {"1m": 0.1, "5m": 0.2, "15m": 0.5, "1h": 2.0, "4h": 8.0, "1d": 48.0, "1wk": 240.0}
STEPS = "symbol string, strategy string, ts timestamp_ntz, equity double, trades array<struct<side:string,entry_ts:timestamp_ntz,entry_price:double,exit_price:double,quantity:double,pnl:double,commission:double,pnl_pct:double,reason:string,hold_bars:bigint>>"


@dataclass(frozen=True)
class Settings:
    capital: float = 100_000.0
    commission: float = 0.001
    min_commission: float = 1.0
    slippage: float = 0.0005
    max_position: float = 0.10
    max_drawdown: float = 0.15
    shorts: bool = True
    #: "reference" charges a short's exit commission twice to cash and its entry commission never.
    accounting: str = "correct"


def commission(value: Column, quantity: Column, mode: str = "percentage", rate: float = 0.001, tiers: tuple[tuple[float, float], ...] = (), least: float = 1.0) -> Column:
    """Commission of an order: share of its value, price per share, or share by the last tier that its quantity reaches."""
    if mode == "percentage":
        fee = value * rate
    elif mode == "per_share":
        fee = quantity * rate
    elif mode == "tiered":
        fee = value * F.coalesce(*(F.when(quantity >= t, r) for t, r in sorted(tiers, reverse=True)), F.lit(rate))
    else:
        raise ValueError(f"unknown commission: {mode}")
    return F.greatest(fee, F.lit(least))


def slippage(order: Column, turnover: Column, base: float = 0.0005) -> Column:
    """Share of the price lost: base, more for orders large against the turnover, from 0.0001 to 0.005."""
    return F.greatest(F.lit(0.0001), F.least(F.lit(0.005), base * (1 + F.coalesce(F.try_divide(order, turnover), F.lit(0.0)))))


class _Bar(NamedTuple):
    ts: object
    close: float
    adv: float
    signal: str
    stop_loss_pct: float
    take_profit_pct: float
    position_size: float


class _Book:
    """Cash and the open position of a run."""

    def __init__(self, s: Settings):
        self.s, self.cash, self.side, self.closed = s, s.capital, 0, []
        self.entry = self.quantity = self.stop = self.take = self.fee = 0.0
        self.at, self.since = None, 0

    def equity(self, price: float) -> float:
        return self.cash if not self.side else self.cash + price * self.quantity if self.side > 0 else self.cash + (self.entry - price) * self.quantity

    def slip(self, value: float, price: float, volume: float) -> float:
        turnover = volume * price if volume == volume and volume > 0 else 0.0
        return min(max(self.s.slippage * (1 + (value / turnover if turnover else 0.0)), 0.0001), 0.005)

    def open(self, side: int, row, number: int) -> None:
        value = self.equity(row.close) * min(row.position_size, self.s.max_position)
        fill = row.close * (1 + side * self.slip(value, row.close, row.adv))
        fee = max(value * self.s.commission, self.s.min_commission)
        value -= fee
        if value <= 0 or fill <= 0:
            return
        self.side, self.entry, self.quantity, self.fee = side, fill, value / fill, fee
        self.stop, self.take, self.at, self.since = row.stop_loss_pct, row.take_profit_pct, row.ts, number
        if side > 0:
            self.cash -= value + fee
        elif self.s.accounting != "reference":
            self.cash -= fee

    def close(self, row, number: int, reason: str) -> None:
        value = self.quantity * row.close
        fill = row.close * (1 - self.side * self.slip(value, row.close, row.adv))
        fee = max(fill * self.quantity * self.s.commission, self.s.min_commission)
        pnl = self.side * (fill - self.entry) * self.quantity - fee
        if self.side > 0:
            self.cash += fill * self.quantity - fee
        else:
            self.cash += pnl - (fee if self.s.accounting == "reference" else 0.0)
        self.closed.append(("LONG" if self.side > 0 else "SHORT", self.at, self.entry, fill, self.quantity, pnl, self.fee + fee, pnl / (self.entry * self.quantity), reason, number - self.since))
        self.side = 0

    def exit_reason(self, price: float) -> str | None:
        move = self.side * (price - self.entry) / self.entry
        return "stop_loss" if move <= -self.stop else "take_profit" if move >= self.take else None


def simulate(signals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """symbol, strategy, ts, equity, trades (closed at this bar) for each bar of each run.

    On every bar: stop or profit of the open position on the close, then the signal (a reversal closes and opens), then equity and
    the drawdown limit, which ends trading for good. Open positions are closed at the last bar.
    """
    bars = signals.withColumn("adv", F.avg("volume").over(Window.partitionBy(*RUN).orderBy("ts").rowsBetween(-20, -1)))
    wanted = bars.select(*RUN, "ts", "close", "adv", "signal", "stop_loss_pct", "take_profit_pct", "position_size")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable")
        book, peak, halted = _Book(settings), settings.capital, False
        equity, trades = [], []
        last = len(frame) - 1
        columns = [frame[c].tolist() for c in ("close", "adv", "signal", "stop_loss_pct", "take_profit_pct", "position_size")]
        for number, row in enumerate(map(_Bar, frame["ts"].tolist(), *columns)):
            if not book.side and (halted or row.signal == "HOLD"):  # nothing can happen
                equity.append(book.cash)
                trades.append([])
                continue
            before = len(book.closed)
            if book.side and (reason := book.exit_reason(row.close)):
                book.close(row, number, reason)
            if not halted and row.signal in ("BUY", "SELL"):
                side = 1 if row.signal == "BUY" else -1
                if book.side == -side:
                    book.close(row, number, "signal_reversal")
                if not book.side and (side > 0 or settings.shorts):
                    book.open(side, row, number)
            now = book.equity(row.close)
            peak = max(peak, now)
            if not halted and (peak - now) / peak > settings.max_drawdown:
                if book.side:
                    book.close(row, number, "circuit_breaker")
                    now = book.cash
                halted = True
            if number == last and book.side:
                book.close(row, number, "end_of_data")
                now = book.cash
            equity.append(now)
            trades.append([dict(zip(("side", "entry_ts", "entry_price", "exit_price", "quantity", "pnl", "commission", "pnl_pct", "reason", "hold_bars"), t)) for t in book.closed[before:]])
        return frame[["symbol", "strategy", "ts"]].assign(equity=equity, trades=trades)

    return wanted.groupBy(*RUN).applyInPandas(fold, STEPS)


def trades_of(steps: DataFrame) -> DataFrame:
    """One row per closed trade."""
    return steps.select(*RUN, F.col("ts").alias("exit_ts"), F.explode("trades").alias("t")).select(*RUN, "exit_ts", "t.*")


def trade_stats(trades: DataFrame, by: list[str] = RUN) -> DataFrame:
    """Counts, win rate, profit factor (999 at most), mean gains and losses, commission, mean holding."""
    win, loss = F.col("pnl") > 0, F.col("pnl") <= 0
    lost = F.abs(F.sum(F.when(loss, F.col("pnl")).otherwise(0.0)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return trades.groupBy(*by).agg(
        F.count("*").alias("n_trades"),
        F.sum(win.cast("long")).alias("n_wins"),
        F.avg(win.cast("double")).alias("win_rate"),
        F.least(F.lit(999.0), F.sum(F.when(win, F.col("pnl")).otherwise(0.0)) / F.when(lost == 0, 1.0).otherwise(lost)).alias("profit_factor"),
        zero(F.avg(F.when(win, F.col("pnl_pct")))).alias("mean_win_pct"),
        zero(F.avg(F.when(loss, F.col("pnl_pct")))).alias("mean_loss_pct"),
        F.sum("commission").alias("commission"),
        F.avg("hold_bars").alias("mean_hold"),
    )


def detect_timeframe(rows: DataFrame, by: list[str], default: str = "1d") -> DataFrame:
    """by, timeframe: class of the median spacing of rows in time; `default` for ten rows or fewer."""
    spaced = rows.withColumn("_h", _spacing(Window.partitionBy(*by).orderBy("ts"))).groupBy(*by).agg(F.median("_h").alias("median_hours"), F.count("*").alias("_rows"))
    return spaced.select(*by, "median_hours", _timeframe(F.col("median_hours"), F.col("_rows"), default).alias("timeframe"))


def _spacing(w: WindowSpec) -> Column:
    """Hours since the row before."""
    hours = F.col("ts").cast("timestamp").cast("double") / 3600
    return hours - F.lag(hours).over(w)


def _timeframe(median_hours: Column, rows: Column, default: str) -> Column:
    ladder = F.lit("1mo")
    for name, below in sorted(SPACINGS.items(), key=lambda x: -x[1]):
        ladder = F.when(median_hours < below, name).otherwise(ladder)
    return F.when(median_hours.isNull() | (rows <= 10), default).otherwise(ladder)


def curve_metrics(curve: DataFrame, by: list[str] = RUN, capital: float = 100_000.0, more: tuple[Column, ...] = ()) -> DataFrame:
    """Final equity, total return, drawdown and its longest run, Sharpe, Sortino, Calmar of equity curves (by, ts, equity).

    The curve is read once, in one grouping; `more`: further aggregates of its columns.
    """
    w = Window.partitionBy(*by).orderBy("ts")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    df = curve.withColumns({"_peak": F.max("equity").over(sofar), "_ret": F.try_divide(F.col("equity") - F.lag("equity").over(w), F.lag("equity").over(w))})
    df = df.withColumn("_h", _spacing(w))
    df = df.withColumn("_dd", F.try_divide(F.col("equity") - F.col("_peak"), F.col("_peak")))
    # rows under water since the last row at the peak: the number of rows in their island
    df = df.withColumn("_island", F.sum((F.col("_dd") >= 0).cast("long")).over(sofar))
    df = df.withColumn("_under", F.sum((F.col("_dd") < 0).cast("long")).over(Window.partitionBy(*by, "_island").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
    negative = F.when(F.col("_ret") < 0, F.col("_ret"))
    out = df.groupBy(*by).agg(F.max_by("equity", "ts").alias("final_equity"), F.max(-F.col("_dd")).alias("max_drawdown"), F.max("_under").alias("longest_drawdown"), F.avg("_ret").alias("_mean"), F.stddev_pop("_ret").alias("_sd"), F.coalesce(F.stddev_pop(negative), F.lit(1.0)).alias("_neg"), F.median("_h").alias("_hours"), F.count("*").alias("_rows"), *more)
    out = out.withColumn("timeframe", _timeframe(F.col("_hours"), F.col("_rows"), "1d"))
    a = F.sqrt(F.element_at(F.create_map(*(F.lit(x) for kv in BARS_A_YEAR.items() for x in kv)), F.col("timeframe")))
    ratio = lambda sd: F.coalesce(F.try_divide(F.col("_mean"), F.col(sd)) * a, F.lit(0.0))
    total = F.col("final_equity") / capital - 1
    return out.select(*by, "final_equity", total.alias("total_return"), "max_drawdown", "longest_drawdown", ratio("_sd").alias("sharpe"), ratio("_neg").alias("sortino"), F.coalesce(F.try_divide(total, F.col("max_drawdown")), F.lit(0.0)).alias("calmar"), "timeframe", *(c for c in out.columns if c.startswith("more_")))


def monthly_returns(curve: DataFrame, by: list[str] = RUN) -> DataFrame:
    """by, month (YYYY-MM), monthly_return: change of each month's last equity; months without rows keep the one before."""
    ends = curve.groupBy(*by, F.trunc(F.col("ts").cast("date"), "month").alias("m")).agg(F.max_by("equity", "ts").alias("equity"))
    spine = ends.groupBy(*by).agg(F.min("m").alias("a"), F.max("m").alias("b")).select(*by, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    w = Window.partitionBy(*by).orderBy("m")
    full = spine.join(ends, [*by, "m"], "left").withColumn("equity", F.last("equity", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    full = full.withColumn("monthly_return", F.round(F.try_divide(F.col("equity") - F.lag("equity").over(w), F.lag("equity").over(w)), 6))
    return full.where("monthly_return IS NOT NULL").select(*by, F.date_format("m", "yyyy-MM").alias("month"), "monthly_return")


def report(signals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of metrics per run; runs without trades have zeros."""
    steps = simulate(signals, settings)
    # a run's trades are gathered where its curve is measured, so nothing is simulated twice
    metrics = curve_metrics(steps.select(*RUN, "ts", "equity", "trades"), RUN, settings.capital, (F.flatten(F.collect_list("trades")).alias("more_trades"),))
    t = F.col("more_trades")
    total = lambda rows, c: F.aggregate(rows, F.lit(0.0), lambda a, x: a + x[c])
    mean = lambda rows, c: F.coalesce(F.try_divide(total(rows, c), F.size(rows)), F.lit(0.0))
    win, loss = F.filter(t, lambda x: x["pnl"] > 0), F.filter(t, lambda x: x["pnl"] <= 0)
    lost = F.abs(total(loss, "pnl"))
    counts = {"n_trades": F.size(t).cast("long"), "n_wins": F.size(win).cast("long"), "win_rate": F.coalesce(F.try_divide(F.size(win), F.size(t)), F.lit(0.0)), "profit_factor": F.least(F.lit(999.0), total(win, "pnl") / F.when(lost == 0, 1.0).otherwise(lost))}
    counts |= {"mean_win_pct": mean(win, "pnl_pct"), "mean_loss_pct": mean(loss, "pnl_pct"), "commission": total(t, "commission"), "mean_hold": mean(t, "hold_bars")}
    return metrics.withColumns(counts).drop("more_trades")


def downsample(curve: DataFrame, most: int, by: list[str] = RUN) -> DataFrame:
    """Every n-th point of each curve, n the length over `most`."""
    w = Window.partitionBy(*by)
    numbered = curve.withColumns({"_k": F.row_number().over(w.orderBy("ts")) - 1, "_n": F.count("*").over(w)})
    return numbered.where(F.col("_k") % F.greatest(F.lit(1), F.floor(F.col("_n") / most)) == 0).drop("_k", "_n")
