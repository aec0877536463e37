"""A trading desk over tables: scans of scores, lists of the newest and strongest, reasons, paper trades, walk-forward runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import fixed
from tidemark.operators import alerts, backtest, splits
from tidemark.operators.consensus import WEIGHTS
from tidemark.operators.signals import signals

#: Scores beyond which a symbol counts as a buy or a sell; share of cash in one trade; drawdown that stops new trades (fixed values).
BIAS, MAX_TRADE, MAX_DRAWDOWN = 0.3, 0.10, 0.15
#: Columns of a grid of backtests, by our names (fixed values).
GRID = {
    "symbol": "symbol", "strategy_name": "strategy", "total_return_pct": "total_return", "win_rate": "win_rate", "sharpe_ratio": "sharpe", "max_drawdown_pct": "max_drawdown", "profit_factor": "profit_factor",
    "total_trades": "n_trades", "sortino_ratio": "sortino", "calmar_ratio": "calmar", "avg_hold_bars": "mean_hold", "total_commission": "commission",
}


def scan_summary(scores: DataFrame) -> DataFrame:
    """One row: symbols, buys (score above BIAS), sells (below -BIAS), neutral ones of (symbol, consensus)."""
    buys, sells = F.count_if(F.col("consensus") > BIAS), F.count_if(F.col("consensus") < -BIAS)
    return scores.agg(F.count("*").alias("symbols"), buys.alias("buys"), sells.alias("sells"), (F.count("*") - buys - sells).alias("neutral"))


def top(rows: DataFrame, order: list[Column], n: int, by: list[str] | None = None) -> DataFrame:
    """The first n rows in an order, of all or of each `by`, with their rank (a report: the limit is its purpose).

    Of all: each task keeps n before they meet. Of each key: tasks keep n a key before the shuffle.
    """
    if by:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
    return rows.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def strongest(scores: DataFrame, n: int) -> DataFrame:
    """Scan results by the size of their score."""
    return top(scores, [F.desc(F.abs("consensus")), F.col("symbol")], n)


def newest(rows: DataFrame, n: int, key: str, by: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """The n newest rows (recent alerts, trades, bars), ties by key."""
    return top(rows, [F.desc(ts), F.col(key)], n, by)


def review_queue(labelled: DataFrame, n: int, key: str = "vec_id") -> DataFrame:
    """Rows that need review, the least clear first."""
    return top(labelled.where("status = 'needs_review'"), [F.col("margin"), F.col(key)], n)


def decision_log(decisions: DataFrame, actions: list[str], symbols: list[str] | None = None, n: int = 50) -> DataFrame:
    """The n newest decisions (decision_id, symbol, action, ts) of some actions and symbols."""
    rows = decisions.where(F.col("action").isin(actions))
    return newest(rows.where(F.col("symbol").isin(symbols)) if symbols else rows, n, "decision_id")


def reasoning(votes: DataFrame, decisions: DataFrame) -> DataFrame:
    """(decision_id, reasoning): the consensus, who voted what with which weight, who was left out, whether risk blocked it.

    votes: decision_id, agent, recommendation, confidence, status; decisions: decision_id, consensus, approved. A decision's votes
    are as many as there are agents.
    """
    factor = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for a, (_, m) in WEIGHTS.items() for x in (a, m))), F.col("agent")), F.lit(1.0))
    out = F.coalesce(F.col("status") == "NOT_IMPLEMENTED", F.lit(False)) | (factor == 0)
    line = F.format_string("  %s [x%.0f]: %s (conf=%s)", "agent", factor, "recommendation", fixed(F.col("confidence"), 2))
    listed = votes.groupBy("decision_id").agg(*(F.array_sort(F.collect_list(F.when(c, F.struct("agent", line.alias("line"))))).alias(name) for c, name in ((~out, "active"), (out, "excluded"))))
    names = lambda c: F.transform(c, lambda v: v["agent"])
    active = F.format_string("Active agents (%d): %s", F.size("active"), F.when(F.size("active") > 0, F.array_join(names(F.col("active")), ", ")).otherwise("none"))
    excluded = F.when(F.size("excluded") > 0, F.format_string("Excluded agents (%d): %s", F.size("excluded"), F.array_join(names(F.col("excluded")), ", ")))
    lines = F.when(F.size("active") > 0, F.array_join(F.transform("active", lambda v: v["line"]), "\n"))
    blocked = F.when(~F.col("approved"), "  >>> BLOCKED by risk")
    joined = decisions.join(listed, "decision_id", "left")
    return joined.select("decision_id", F.concat_ws("\n", F.format_string("Consensus: %s", fixed(F.col("consensus"), 4)), active, lines, excluded, blocked).alias("reasoning"))


POSITIONS = "account string, symbol string, side string, entry_price double, quantity double, stop_loss double, take_profit double"


def paper_scan(accounts: DataFrame, positions: DataFrame, prices: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One scan of paper accounts: (accounts, positions, trades) after it, so that the next scan can follow.

    accounts: account, cash, peak. positions: account, symbol, side, entry_price, quantity, stop_loss, take_profit. prices:
    symbol, price. decisions: account, symbol, action, approved, position_size, stop_loss, take_profit (0.02 and 0.04 where they are
    missing). First every position whose stop or profit is reached is closed. Then approved decisions on symbols without a position open one, in the order of symbols, each
    for its share of the cash that the ones before it left, unless the account is more than MAX_DRAWDOWN below its peak. Positions
    without a price stay as they are. trades: account, symbol, event (stop_loss, take_profit, open), side, price, quantity, pnl.
    """
    sign = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    held = positions.join(prices, "symbol", "left").withColumn("pnl", sign * (F.col("price") - F.col("entry_price")) * F.col("quantity"))
    move = F.try_divide(sign * (F.col("price") - F.col("entry_price")), F.col("entry_price"))
    held = held.withColumn("event", F.when(move <= -F.col("stop_loss"), "stop_loss").when(move >= F.col("take_profit"), "take_profit"))
    worth = F.coalesce(F.when(F.col("side") == "LONG", F.coalesce("price", "entry_price") * F.col("quantity")).otherwise(F.col("pnl")), F.lit(0.0))
    sums = held.groupBy("account").agg(F.sum(F.when(F.col("event").isNotNull(), worth).otherwise(0.0)).alias("freed"), F.sum(F.when(F.col("event").isNull(), worth).otherwise(0.0)).alias("worth"))
    state = accounts.join(sums, "account", "left").fillna(0.0, subset=["freed", "worth"]).withColumn("cash", F.col("cash") + F.col("freed"))
    state = state.withColumn("equity", F.col("cash") + F.col("worth"))
    state = state.withColumn("open", F.coalesce(F.try_divide(F.col("peak") - F.col("equity"), F.col("peak")) <= MAX_DRAWDOWN, F.lit(True)))
    kept = held.where("event IS NULL").select("account", "symbol")
    wanted = decisions.where("approved AND action IN ('BUY', 'SELL')").join(kept, ["account", "symbol"], "left_anti").join(prices.where("price > 0"), "symbol").join(state.where("open").select("account", "cash"), "account")
    share = F.least("position_size", F.lit(MAX_TRADE))
    order = Window.partitionBy("account").orderBy("symbol")
    # only longs take cash, each a share of what is left: a product, as a sum of logarithms
    left = F.exp(F.coalesce(F.sum(F.when(F.col("action") == "BUY", F.ln(1 - share)).otherwise(0.0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    opened = wanted.withColumn("value", F.col("cash") * left * share).where("value > 0")
    taken = opened.groupBy("account").agg(F.sum(F.when(F.col("action") == "BUY", F.col("value")).otherwise(0.0)).alias("taken"))
    after = state.join(taken, "account", "left").select("account", (F.col("cash") - F.coalesce("taken", F.lit(0.0))).alias("cash"), "equity", F.greatest("peak", "equity").alias("peak"))
    closes = held.where("event IS NOT NULL").select("account", "symbol", "event", "side", "price", "quantity", "pnl")
    opened = opened.withColumns({"side": F.when(F.col("action") == "BUY", "LONG").otherwise("SHORT"), "quantity": F.col("value") / F.col("price")})
    opens = opened.select("account", "symbol", F.lit("open").alias("event"), "side", "price", "quantity", F.lit(0.0).alias("pnl"))
    share_of = lambda c, missing: (F.coalesce(F.col(c).cast("double"), F.lit(missing)) if c in decisions.columns else F.lit(missing)).alias(c)
    new = opened.select("account", "symbol", "side", F.col("price").alias("entry_price"), "quantity", share_of("stop_loss", 0.02), share_of("take_profit", 0.04))
    kept_on = held.where("event IS NULL").select(new.columns)
    return after, kept_on.unionByName(new), closes.unionByName(opens)


def strategy_alerts(bars: DataFrame, names: list[str], rules: DataFrame, last_only: bool = False) -> DataFrame:
    """Alerts that strategies' signals raise: matched by rules, then cooled down. `last_only`: of each symbol's newest bar, as a watcher sees it."""
    found = signals(bars, names).select("symbol", "ts", "strategy", "signal", "confidence")
    found = found.withColumn("score", F.when(F.col("signal") == "SELL", -F.col("confidence")).otherwise(F.col("confidence")))
    if last_only:
        newest_bar = Window.partitionBy("symbol", "strategy").orderBy(F.desc("ts"))
        found = found.withColumn("_k", F.row_number().over(newest_bar)).where("_k = 1").drop("_k")
    return alerts.cool_down(alerts.matches(found.drop("strategy"), rules))


def backtest_grid(bars: DataFrame, jobs: DataFrame, names: list[str], settings: backtest.Settings = backtest.Settings()) -> DataFrame:
    """Every job (symbol, strategy) with the metrics of GRID and `error`: null, no_data, or that the strategy is unknown.

    Jobs are rows; a job that can't run costs its own row only.
    """
    report = backtest.report(signals(bars, names).join(jobs.select("symbol", "strategy").distinct(), ["symbol", "strategy"], "left_semi"), settings)
    joined = jobs.select("symbol", "strategy").distinct().join(report, ["symbol", "strategy"], "left")
    error = F.when(~F.col("strategy").isin(names), F.concat(F.lit("unknown strategy: "), "strategy")).when(F.col("final_equity").isNull(), "no_data")
    return joined.select(*(F.col(ours).alias(name) for name, ours in GRID.items()), error.alias("error"))


def overview(bars: DataFrame) -> DataFrame:
    """symbol, first, last (closes by time), pct (change between them in per cent, null from 0), high, volume (mean): one row a symbol."""
    ends = bars.groupBy("symbol").agg(F.min_by("close", "ts").alias("first"), F.max_by("close", "ts").alias("last"), F.max("high").alias("high"), F.avg("volume").alias("volume"))
    return ends.select("symbol", "first", "last", (F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100).alias("pct"), "high", "volume")


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """bin (from 0), n: rows in each of `bins` equal parts of low to high that has any; `high` belongs to the last part.

    Values below or above are in bins -1 and `bins`, null and NaN in the bin null, so the counts sum to the rows.
    """
    value = F.col(column).cast("double")
    inside = F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1))
    place = F.when(value.isNull() | F.isnan(value), F.lit(None)).when(value < low, -1).when(value > high, bins).otherwise(inside)
    return rows.groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


#: Analyses of windows trade on whatever the drawdown.
NO_BREAKER = backtest.Settings(max_drawdown=1.0)


def window_parts(bars: DataFrame, windows: int = 5, train: float = 0.6, step: float = 0.1, least: int = 10) -> DataFrame:
    """bars, once for each part that they belong to, with `symbol` as symbol|window|train or symbol|window|test.

    Windows are anchored: the first trains on the share `train` of a symbol's rows, each further one on a step (a share of the rows, one at
    least) more; the test is the step that follows, shorter at the end. Windows whose test has fewer than `least` rows are left out.
    """
    w = Window.partitionBy("symbol")
    numbered = bars.withColumns({"_row": F.row_number().over(w.orderBy("ts")) - 1, "_n": F.count("*").over(w)})
    width = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(step)))
    cuts = [F.floor(F.col("_n") * F.lit(train)) + k * width for k in range(windows)]
    parts = F.array(*(F.struct(F.lit(k).alias("window"), cut.alias("cut"), F.least(cut + width, F.col("_n")).alias("end")) for k, cut in enumerate(cuts)))
    held = F.filter(parts, lambda p: (p["end"] - p["cut"] >= max(least, 1)) & (F.col("_row") < p["end"]))
    each = numbered.withColumn("_p", F.explode(held))
    name = F.concat_ws("|", "symbol", F.col("_p.window").cast("string"), F.when(F.col("_row") < F.col("_p.cut"), "train").otherwise("test"))
    return each.withColumn("symbol", name).select(bars.columns)


def walk_forward(bars: DataFrame, names: list[str], windows: int = 5, train: float = 0.6, step: float = 0.1, least: int = 10, settings: backtest.Settings = NO_BREAKER) -> DataFrame:
    """(symbol, strategy, window, train_sharpe, test_sharpe, test_return, test_win_rate): backtests of both parts of every window.

    Parts are as `window_parts` makes them, runs of their own: a strategy sees nothing before its part, so its indicators begin
    anew there, and all parts are simulated side by side.
    """
    report = backtest.report(signals(window_parts(bars, windows, train, step, least), names), settings)
    part, window = F.substring_index("symbol", "|", -1), F.substring_index(F.substring_index("symbol", "|", -2), "|", 1)
    of = lambda c, p: F.max(F.when(part == p, F.col(c)))
    return report.groupBy(F.regexp_replace("symbol", r"\|[0-9]+\|[a-z]+$", "").alias("symbol"), "strategy", window.cast("int").alias("window")).agg(
        of("sharpe", "train").alias("train_sharpe"), of("sharpe", "test").alias("test_sharpe"), of("total_return", "test").alias("test_return"), of("win_rate", "test").alias("test_win_rate")
    )


def walk_forward_report(bars: DataFrame, names: list[str], **options) -> DataFrame:
    """Means over the windows of each (symbol, strategy), stability and overfit; options as of `walk_forward`."""
    return splits.walk_forward_summary(walk_forward(bars, names, **options), ["symbol", "strategy"])
