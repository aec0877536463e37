"""Strategies as expressions: each adds signal, confidence, stop_loss_pct, take_profit_pct, position_size to bars."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import by_symbol, ema, lag, roll, safe_div
from tidemark.operators.features import macd, native_features, rsi, with_changes

Strategy = Callable[[DataFrame], DataFrame]
BARS = ("symbol", "ts", "open", "high", "low", "close", "volume")


#: Columns of a strategy's signals beside those of bars.
SIGNALS = ("signal", "confidence", "stop_loss_pct", "take_profit_pct", "position_size")


@dataclass(frozen=True)
class Rule:
    """A strategy in parts, so that several share one pass over the bars.

    means: recursive means it reads. steps: columns over windows of a symbol, each step reading those before it; their names begin with the
    strategy's. buy, sell, confidence: expressions over all of these.
    """

    name: str
    buy: Column
    sell: Column
    confidence: Column
    stop: float
    take: float
    means: dict = field(default_factory=dict)
    steps: tuple[dict[str, Column], ...] = ()
    changes: bool = False
    size: float = 0.02

    def signal(self) -> Column:
        """struct of the strategy's name and SIGNALS."""
        signal = F.when(F.coalesce(self.buy, F.lit(False)), "BUY").when(F.coalesce(self.sell, F.lit(False)), "SELL").otherwise("HOLD")
        confidence = F.when(signal == "HOLD", 0.0).otherwise(self.confidence)
        return F.struct(F.lit(self.name).alias("strategy"), signal.alias("signal"), confidence.alias("confidence"), F.lit(self.stop).alias("stop_loss_pct"), F.lit(self.take).alias("take_profit_pct"), F.lit(self.size).alias("position_size"))


def apply_rules(bars: DataFrame, rules: list[Rule]) -> DataFrame:
    """Signals of all rules, a row for each bar and rule: one scan of the bars, one pass of recursive means, one sort for all windows."""
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("strategies need names of their own")
    df = bars.select(*BARS)
    if means := {n: m for r in rules for n, m in r.means.items()}:
        df = ema(df, means)
    if any(r.changes for r in rules):
        df = with_changes(df, "inf")
    for step in range(max((len(r.steps) for r in rules), default=0)):
        df = df.withColumns({n: c for r in rules if step < len(r.steps) for n, c in r.steps[step].items()})
    return df.select(*BARS, F.inline(F.array(*(r.signal() for r in rules))))


def _ma_crossover(fast: int = 20, slow: int = 50, kind: str = "ema", stop: float = 0.02, take: float = 0.04, name: str = "ma_cross") -> Rule:
    f, s, pf, ps = (f"{name}_{c}" for c in ("f", "s", "pf", "ps"))
    means = {f: ("close", fast), s: ("close", slow)} if kind == "ema" else {}
    plain = () if kind == "ema" else ({f: roll(F.avg, "close", fast), s: roll(F.avg, "close", slow)},)
    confidence = F.least(0.5 + 20 * F.abs(F.try_divide(F.col(f) - F.col(s), F.col(s))), F.lit(0.95))
    buy, sell = (F.col(pf) <= F.col(ps)) & (F.col(f) > F.col(s)), (F.col(pf) >= F.col(ps)) & (F.col(f) < F.col(s))
    return Rule(name, buy, sell, confidence, stop, take, means, (*plain, {pf: lag(f), ps: lag(s)}))


def _rsi_reversion(n: int = 14, low: float = 30.0, high: float = 70.0, stop: float = 0.015, take: float = 0.03, name: str = "rsi_reversion") -> Rule:
    now, one, two = (f"{name}_{c}" for c in ("r", "1", "2"))
    r, r1, r2 = map(F.col, (now, one, two))
    buy, sell = (r2 < low) & (r1 < low) & (r > low), (r2 > high) & (r1 > high) & (r < high)
    confidence = F.when(buy, F.least(0.55 + (low - F.least(r1, r2)) / low, F.lit(0.9))).otherwise(F.least(0.55 + (F.greatest(r1, r2) - high) / (100 - high), F.lit(0.9)))
    return Rule(name, buy, sell, confidence, stop, take, steps=({now: rsi(n=n, zero="inf")}, {one: lag(now, 1), two: lag(now, 2)}), changes=True)


def _bollinger_breakout(n: int = 20, width: float = 2.0, stop: float = 0.02, take: float = 0.03, name: str = "bollinger") -> Rule:
    now, one = f"{name}_p", f"{name}_1"
    sigma, middle = roll(F.stddev_samp, "close", n), roll(F.avg, "close", n)
    p, p1 = F.col(now), F.col(one)
    steps = ({now: safe_div(F.col("close") - (middle - width * sigma), 2 * width * sigma)}, {one: lag(now)})
    return Rule(name, (p1 < 0.05) & (p > 0.05), (p1 > 0.95) & (p < 0.95), F.lit(0.65), stop, take, steps=steps)


def _macd_histogram(fast: int = 12, slow: int = 26, signal: int = 9, stop: float = 0.02, take: float = 0.04, name: str = "macd") -> Rule:
    f, s, m, now, one = (f"{name}_{c}" for c in ("f", "s", "m", "h", "1"))
    h, h1 = F.col(now), F.col(one)
    steps = ({now: F.col(f) - F.col(s) - F.col(m)}, {one: lag(now)})
    return Rule(name, (h1 <= 0) & (h > 0), (h1 >= 0) & (h < 0), F.lit(0.60), stop, take, {f: ("close", fast), s: ("close", slow), m: ((f, s), signal)}, steps)


def ma_crossover(bars: DataFrame, **options) -> DataFrame:
    """The fast mean (20) crosses the slow one (50); confidence grows with the distance. Options: fast, slow, kind (ema or sma), stop, take, name."""
    return apply_rules(bars, [_ma_crossover(**options)])


def rsi_reversion(bars: DataFrame, **options) -> DataFrame:
    """Two bars beyond a bound, then back within; confidence grows with how far beyond they were. Options: n, low, high, stop, take, name."""
    return apply_rules(bars, [_rsi_reversion(**options)])


def bollinger_breakout(bars: DataFrame, **options) -> DataFrame:
    """The close leaves the outer twentieth of the band inwards. Options: n, width, stop, take, name."""
    return apply_rules(bars, [_bollinger_breakout(**options)])


def macd_histogram(bars: DataFrame, **options) -> DataFrame:
    """The histogram changes its sign. Options: fast, slow, signal, stop, take, name."""
    return apply_rules(bars, [_macd_histogram(**options)])


def _signals(df: DataFrame, rule: Rule, extra: tuple[str, ...]) -> DataFrame:
    return df.select(*BARS, F.inline(F.array(rule.signal())), *extra)


def agent_consensus(bars: DataFrame, threshold: float = 0.30, warm_up: int = 200, name: str = "consensus") -> DataFrame:
    """Mean of five votes in [-1, 1]: RSI, MACD histogram by its recent 95th percentile, means, bands, and volume on top.

    Adds `votes`, a map; an indicator without a value has no vote in it. Bars before the `warm_up`th hold; so does a score of
    just the threshold.
    """
    df = native_features(bars, "inf")
    df = macd(df).withColumnRenamed("macd_histogram", "_h")
    recent = by_symbol().rowsBetween(-50, 0)
    df = df.withColumns({"_q": F.percentile(F.abs("_h"), 0.95).over(recent), "_n": F.count("_h").over(recent), "_row": F.row_number().over(by_symbol()) - 1})
    # least and greatest pass over nulls; a missing value must not vote
    clip = lambda c, low=-1.0: F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1.0)), F.lit(low)))
    by_rsi = clip((50 - F.col("rsi")) / 25)
    by_macd = F.when((F.col("_q") == 0) | (F.col("_n") <= 5), F.when(F.col("_h") > 0, 1.0).when(F.col("_h") <= 0, -1.0)).otherwise(clip(F.try_divide(F.col("_h"), F.col("_q"))))
    by_mean = clip(F.try_divide(F.col("sma_20") - F.col("sma_50"), F.col("sma_50")) / 0.02)
    by_band = clip(1 - 2 * F.col("bb_position"))
    df = df.withColumn("_v", F.array_compact(F.array(by_rsi, by_macd, by_mean, by_band)))
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), F.size(a))
    by_volume = F.coalesce(mean(F.col("_v")), F.lit(0.0)) * clip((F.col("volume_ratio") - 1) / 2, 0.0)
    df = df.withColumn("votes", F.map_filter(F.create_map(F.lit("rsi"), by_rsi, F.lit("macd"), by_macd, F.lit("ma"), by_mean, F.lit("bb"), by_band, F.lit("volume"), by_volume), lambda k, v: v.isNotNull()))
    df = df.withColumn("score", F.when(F.col("_row") >= warm_up, mean(F.map_values("votes"))))
    return _signals(df, Rule(name, F.col("score") > threshold, F.col("score") < -threshold, F.least(F.abs("score"), F.lit(0.95)), 0.02, 0.04), ("score", "votes"))


#: Presets that share a pass, by name.
RULES: dict[str, Callable[..., Rule]] = {
    "ma_cross": _ma_crossover,
    "ma_cross_fast": partial(_ma_crossover, fast=10, slow=30, name="ma_cross_fast"),
    "ma_cross_sma": partial(_ma_crossover, kind="sma", name="ma_cross_sma"),
    "rsi_reversion": _rsi_reversion,
    "bollinger": _bollinger_breakout,
    "macd": _macd_histogram,
}
#: Every preset by name, and strategies that are added to it.
STRATEGIES: dict[str, Strategy] = {**{n: partial(lambda bars, rule: apply_rules(bars, [rule()]), rule=r) for n, r in RULES.items()}, "consensus": agent_consensus}


def signals(bars: DataFrame, names: list[str]) -> DataFrame:
    """Signals of several strategies in one table; those of RULES are made together from one scan, any other by itself."""
    columns = [*BARS, "strategy", *SIGNALS]
    together = [n for n in names if n in RULES]
    parts = [apply_rules(bars, [RULES[n]() for n in together]).select(*columns)] if together else []
    parts += [STRATEGIES[n](bars).select(*columns) for n in names if n not in RULES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
