"""Technical features of bars: window expressions per symbol, one fold for the recursive means."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_symbol, ema, ffill, lag, roll, safe_div

SMA = EMA = (5, 10, 20, 50, 200)
KEYS = ("symbol", "ts", "open", "high", "low", "close", "volume")


def rsi(close: str = "close", n: int = 14, zero: str = "null") -> Column:
    """100 - 100 / (1 + mean gain / mean loss), plain means of n changes; without losses null, or 100 if zero is "inf".

    In "inf" mode the first change counts as 0, so that the first value is one bar earlier.
    """
    change = F.col(close) - lag(close)
    change = F.coalesce(change, F.lit(0.0)) if zero == "inf" else change
    # window functions don't nest: changes are columns `_gain` and `_loss` made by `with_changes`
    gain, loss = roll(F.avg, "_gain", n), roll(F.avg, "_loss", n)
    ratio = F.try_divide(gain, loss)
    value = 100 - 100 / (1 + ratio)
    return F.when((loss == 0) & (gain > 0), 100.0).otherwise(value) if zero == "inf" else value


def with_changes(bars: DataFrame, zero: str = "null") -> DataFrame:
    """Helper columns that other windows read: changes, gains, losses, true range."""
    change = F.col("close") - lag("close")
    gain, loss = F.greatest(change, F.lit(0.0)), F.greatest(-change, F.lit(0.0))
    if zero == "inf":
        gain, loss = F.coalesce(gain, F.lit(0.0)), F.coalesce(loss, F.lit(0.0))
    else:
        gain, loss = F.when(change.isNotNull(), gain), F.when(change.isNotNull(), loss)
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))
    signed = F.signum(F.coalesce(change, F.lit(0.0))) * F.col("volume")
    return bars.withColumns({"price_change": change, "returns": F.try_divide(change, lag("close")), "_gain": gain, "_loss": loss, "_tr": true_range, "_signed": signed, "_abs": F.abs(change)})


def native_features(bars: DataFrame, zero: str = "null") -> DataFrame:
    """All features but the recursive means; helper columns (with a leading underscore) stay for `features`."""
    df = with_changes(bars, zero)
    columns: dict[str, Column] = {
        "log_returns": F.log(F.try_divide(F.col("close"), lag("close"))),
        **{f"sma_{n}": roll(F.avg, "close", n) for n in SMA},
        "rsi": rsi(zero=zero),
        "bb_middle": roll(F.avg, "close", 20),
        "_sigma": roll(F.stddev_samp, "close", 20),
        "volatility_20": roll(F.stddev_samp, "returns", 20),
        "atr": roll(F.avg, "_tr", 14),
        "volume_sma": roll(F.avg, "volume", 20),
        "obv": F.sum("_signed").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)),
        "_travel": roll(F.sum, "_abs", 10),
        "_moved": F.abs(F.col("close") - lag("close", 10)),
        "hl_spread": F.col("high") - F.col("low"),
        "co_spread": F.col("close") - F.col("open"),
        "ask_volume_sum": F.col("volume") * 0.5,
        "bid_volume_sum": F.col("volume") * 0.5,
        "hour": F.hour("ts").cast("long"),
        "day_of_week": F.weekday("ts").cast("long"),
    }
    df = df.withColumns(columns)
    return df.withColumns(
        {
            "bb_upper": F.col("bb_middle") + 2 * F.col("_sigma"),
            "bb_lower": F.col("bb_middle") - 2 * F.col("_sigma"),
            "bb_width": safe_div(4 * F.col("_sigma"), F.col("bb_middle"), zero),
            "bb_position": safe_div(F.col("close") - (F.col("bb_middle") - 2 * F.col("_sigma")), 4 * F.col("_sigma"), zero),
            "volume_ratio": safe_div(F.col("volume"), F.col("volume_sma"), zero),
            "efficiency_ratio": safe_div(F.col("_moved"), F.col("_travel"), zero),
            "session_london": F.col("hour").between(8, 16).cast("long"),
            "session_ny": F.col("hour").between(13, 21).cast("long"),
            "session_asia": (F.col("hour") <= 8).cast("long"),
        }
    )


def features(bars: DataFrame, zero: str = "null", fill: bool = True) -> DataFrame:
    """bars with every feature. `fill`: carry values forward, then 0 for what is missing, then 0 for infinities."""
    df = native_features(bars, zero)
    df = macd(df, {f"ema_{n}": ("close", n) for n in EMA})
    df = df.drop(*(c for c in df.columns if c.startswith("_")))
    if not fill:
        return df
    doubles = [c for c, t in df.dtypes if t == "double" and c not in KEYS]
    filled = df.withColumns({c: F.coalesce(ffill(F.nanvl(F.col(c), F.lit(None).cast("double"))), F.lit(0.0)) for c in doubles})
    return filled.withColumns({c: F.when(F.abs(c) == float("inf"), 0.0).otherwise(F.col(c)) for c in doubles})


def macd(df: DataFrame, more: dict | None = None, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd (fast mean less slow mean of the close), its signal and their difference; `more`: further means, all in one pass over a symbol."""
    df = ema(df, (more or {}) | {"_fast": ("close", fast), "_slow": ("close", slow), "macd_signal": (("_fast", "_slow"), signal)})
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow"))
    return df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def with_constants(bars: DataFrame) -> DataFrame:
    """bars with source_file 0, dividends and stock splits 0 where unknown, and the close where there is no adjusted close."""
    given = lambda name, default: F.coalesce(F.col(name), default) if name in bars.columns else default
    return bars.withColumns({"source_file": F.lit(0), "dividends": given("dividends", F.lit(0.0)), "stock_splits": given("stock_splits", F.lit(0.0)), "adj_close": given("adj_close", F.col("close"))})


def feature_columns(df: DataFrame) -> list[str]:
    """Columns that a model may see: numbers that are no key and no target."""
    return [c for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint") and c not in (*KEYS, "target", "price_up")]


def direction_target(df: DataFrame) -> DataFrame:
    """price_up: 1 if the next close is higher, else 0; each symbol's last row goes."""
    after = F.lead("close").over(by_symbol())
    return df.withColumn("price_up", (after > F.col("close")).cast("int")).where("price_up IS NOT NULL")


def threshold_target(df: DataFrame, threshold: float = 0.003) -> DataFrame:
    """target: 1 above the threshold, 0 below minus it; what lies between and the last row go."""
    change = F.try_divide(F.lead("close").over(by_symbol()) - F.col("close"), F.col("close"))
    return df.withColumn("target", F.when(change > threshold, 1).when(change < -threshold, 0)).where("target IS NOT NULL")


def latest_vector(df: DataFrame, names: list[str], width: int) -> DataFrame:
    """symbol, vector: the newest row's features, zeros in place of missing ones and at the end up to `width`."""
    have = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names if n in df.columns]
    vector = F.array(*(have + [F.lit(0.0)] * (width - len(have)))[:width])
    return df.groupBy("symbol").agg(F.max_by(vector, "ts").alias("vector"))


def crypto_features(df: DataFrame, per_day: int = 24) -> DataFrame:
    """Further features of markets that never close; needs `native_features` and `macd` columns. Missing and infinite: 0."""
    if per_day < 1:
        raise ValueError("per_day must be at least 1")
    needed = {"close", "high", "low", "volume", "returns", "atr", "obv", "rsi", "macd_histogram", "bb_upper", "bb_lower", "sma_20", "volatility_20"}
    if missing := needed - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    two_pi = 2 * math.pi
    df = df.withColumns({"_abs_obv": F.abs("obv"), "_std10": roll(F.stddev_samp, "returns", 10), "_std50": roll(F.stddev_samp, "returns", 50), "_mean50": roll(F.avg, "volatility_20", 50), "_dev50": roll(F.stddev_samp, "volatility_20", 50)})
    columns = {
        "crypto_volatility_ratio": F.try_divide(F.col("_std10"), F.col("_std50")),
        "crypto_range_pct": F.try_divide(F.col("high") - F.col("low"), F.col("close")) * 100,
        "crypto_atr_pct": F.try_divide(F.col("atr"), F.col("close")) * 100,
        "crypto_volatility_zscore": F.try_divide(F.col("volatility_20") - F.col("_mean50"), F.col("_dev50")),
        "crypto_volume_ratio_8h": F.try_divide(F.col("volume"), roll(F.avg, "volume", 8)),
        "crypto_volume_ratio_24h": F.try_divide(F.col("volume"), roll(F.avg, "volume", 24)),
        "crypto_volume_trend": F.try_divide(roll(F.avg, "volume", 5), roll(F.avg, "volume", 20)),
        "crypto_obv_momentum": F.try_divide(F.col("obv") - lag("obv", 5), roll(F.avg, "_abs_obv", 20)),
        "crypto_momentum_3d": roll(F.sum, "returns", 3 * per_day),
        "crypto_momentum_7d": roll(F.sum, "returns", 7 * per_day),
        "crypto_rsi_divergence": F.col("rsi") - lag("rsi", 5),
        "crypto_macd_histogram_momentum": F.col("macd_histogram") - lag("macd_histogram", 3),
        "crypto_distance_from_high_20": F.try_divide(F.col("close") - roll(F.max, "high", 20), F.col("close")),
        "crypto_distance_from_low_20": F.try_divide(F.col("close") - roll(F.min, "low", 20), F.col("close")),
        "crypto_bb_position": F.try_divide(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")),
        "crypto_mean_reversion_signal": F.try_divide(F.col("close") - F.col("sma_20"), roll(F.stddev_samp, "close", 20)),
        "crypto_hour_sin": F.sin(F.hour("ts") * (two_pi / 24)),
        "crypto_hour_cos": F.cos(F.hour("ts") * (two_pi / 24)),
        "crypto_is_weekend": (F.weekday("ts") >= 5).cast("double"),
        "crypto_day_of_week_sin": F.sin(F.weekday("ts") * (two_pi / 7)),
    }
    df = df.withColumns(columns)
    clean = {c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)) for c in columns}
    return df.withColumns(clean).drop("_abs_obv", "_std10", "_std50", "_mean50", "_dev50")


def ichimoku(bars: DataFrame) -> DataFrame:
    """Conversion and base lines, spans shifted 26 bars ahead, lagging span (the close 26 bars later)."""
    middle = lambda n: (roll(F.max, "high", n) + roll(F.min, "low", n)) / 2
    df = bars.withColumns({"tenkan": middle(9), "kijun": middle(26), "_b": middle(52)})
    return df.withColumns({"senkou_a": lag((F.col("tenkan") + F.col("kijun")) / 2, 26), "senkou_b": lag("_b", 26), "chikou": F.lead("close", 26).over(by_symbol())}).drop("_b")


def _recent(bars: DataFrame, n: int) -> DataFrame:
    return bars.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_k") <= n)


def fibonacci_levels(bars: DataFrame, n: int = 100) -> DataFrame:
    """symbol, level, price: retracements between the highest high and lowest low of the last n bars."""
    ends = _recent(bars, n).groupBy("symbol").agg(F.max("high").alias("top"), F.min("low").alias("bottom"))
    levels = F.explode(F.array(*map(F.lit, (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0))))
    return ends.select("symbol", levels.alias("level"), "top", "bottom").select("symbol", "level", (F.col("top") - F.col("level") * (F.col("top") - F.col("bottom"))).alias("price"))


def gann_fan(bars: DataFrame, n: int = 100) -> DataFrame:
    """symbol, angle, origin, slope: lines from the first lowest low of the last n bars."""
    low = _recent(bars, n).groupBy("symbol").agg(F.min(F.struct("low", "ts")).alias("at"), F.max("high").alias("top"), F.min("low").alias("bottom"), F.count("*").alias("bars"))
    angles = F.explode(F.array(*(F.struct(F.lit(k).alias("angle"), F.lit(v).alias("factor")) for k, v in (("1x1", 1.0), ("1x2", 0.5), ("2x1", 2.0), ("1x3", 0.333), ("3x1", 3.0)))))
    return low.select("symbol", F.col("at.ts").alias("origin"), ((F.col("top") - F.col("bottom")) / F.col("bars")).alias("unit"), angles.alias("a")).select("symbol", "a.angle", "origin", (F.col("unit") * F.col("a.factor")).alias("slope"))
