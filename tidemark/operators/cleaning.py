"""Bars made fit for use: names, types, order, duplicates, impossible rows, splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import lag

# Names under which columns come, split ratios that are recognised.
SYNONYMS = {
    "open": ("open", "<open>", "o", "open_price"), "high": ("high", "<high>", "h", "high_price"), "low": ("low", "<low>", "l", "low_price"),
    "close": ("close", "<close>", "c", "close_price", "price"), "volume": ("volume", "<tickvol>", "vol", "v", "base_volume", "quote_volume"),
    "ts": ("ts", "timestamp", "time", "date", "datetime", "open_time", "close_time", "local_time", "gmt time", "index", "unix"),
    "adj_close": ("adj close", "adj_close", "adjclose"), "dividends": ("dividends",), "stock_splits": ("stock splits", "stock_splits"),
}
SPLITS = [2.0, 3.0, 4.0, 5.0, 10.0, 20.0, 1 / 2, 1 / 3, 1 / 4, 1 / 5, 1 / 10, 1 / 20]
ALIASES = {"BTC": "BTC-USD", "ETH": "ETH-USD", "EURUSD": "EURUSD=X", "GBPUSD": "GBPUSD=X", "USDJPY": "USDJPY=X", "GOLD": "GC=F", "OIL": "CL=F", "SPX": "^GSPC", "NASDAQ": "^IXIC", "DOW": "^DJI"}


def to_time(c: Column) -> Column:
    """A time from text, or from a number of milliseconds (above 1e12) or seconds (above 1e9)."""
    number = c.cast("string").try_cast("double")
    epoch = F.when(number > 1e12, F.timestamp_millis(number.cast("long"))).when(number > 1e9, F.timestamp_seconds(number))
    return F.when(number.isNotNull(), epoch).otherwise(F.try_to_timestamp(c.cast("string"))).cast("timestamp_ntz")


def normalize_ohlcv(raw: DataFrame) -> DataFrame:
    """Columns renamed by SYNONYMS, numbers as doubles (null where they aren't), times as timestamps."""
    lower = {c.lower(): c for c in reversed(raw.columns)}
    columns = []
    for name, names in SYNONYMS.items():
        if source := next((lower[n] for n in names if n in lower), None):
            c = F.col(f"`{source}`")
            is_time = name == "ts" and dict(raw.dtypes)[source].startswith("timestamp")
            columns.append((c.cast("timestamp_ntz") if is_time else to_time(c) if name == "ts" else c.cast("string").try_cast("double")).alias(name))
    return raw.select(*([F.col("symbol")] if "symbol" in raw.columns else []), *columns)


def drop_empty(bars: DataFrame) -> DataFrame:
    """Without rows in which open, high, low, close and volume are all null."""
    return bars.dropna(how="all", subset=[c for c in ("open", "high", "low", "close", "volume") if c in bars.columns])


def keep_last(bars: DataFrame, order: str = "seq") -> DataFrame:
    """One row per (symbol, ts): the one that came last."""
    w = Window.partitionBy("symbol", "ts").orderBy(F.col(order).desc())
    return bars.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def validate(bars: DataFrame, strict: bool = False, prices: Sequence[str] = ("open", "high", "low", "close")) -> DataFrame:
    """Without rows in which one of `prices` is <= 0, high < low or negative volume. Nulls pass, unless `strict`, which asks for all four prices."""
    tests = [*(F.col(c) > 0 for c in prices), F.col("high") >= F.col("low"), F.col("volume") >= 0]
    if strict:
        tests += [F.col(c).isNotNull() for c in ("open", "high", "low", "close")]
    return bars.where(reduce(and_, (F.coalesce(t, F.lit(not strict)) for t in tests)))


def between(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a range of times, both ends in."""
    if start:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return bars.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz")) if end else bars


def price_gaps(bars: DataFrame, share: float = 0.5) -> DataFrame:
    """Rows whose close is more than `share` away from the one before."""
    change = F.abs(F.try_divide(F.col("close") - lag("close"), lag("close")))
    return bars.withColumn("gap", change).where(F.col("gap") > share)


def adjust(bars: DataFrame) -> DataFrame:
    """Prices times adj_close / close (rounded half to even, 6 places), volume divided by it; symbols without a difference stay as they are."""
    factor = F.coalesce(F.try_divide(F.col("adj_close"), F.col("close")), F.lit(1.0))
    differs = F.max(F.abs(F.col("adj_close") - F.col("close"))).over(Window.partitionBy("symbol")) >= 1e-8
    out = bars.withColumns({"_f": F.when(differs, factor).otherwise(1.0), "_d": F.coalesce(differs, F.lit(False))})
    changed = {c: F.when(F.col("_d"), F.bround(F.col(c) * F.col("_f"), 6)).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}
    changed["volume"] = F.when(F.col("_d"), F.bround(F.try_divide(F.col("volume"), F.when(F.col("_f") == 0, 1.0).otherwise(F.col("_f"))), 0)).otherwise(F.col("volume"))
    return out.withColumns(changed).drop("_f", "_d")


def detect_splits(bars: DataFrame, jump: float = 0.30, tolerance: float = 0.05) -> DataFrame:
    """symbol, ts, ratio (4 places), label ("n:1" or "1:n"): closes that jump by about one of SPLITS."""
    r = F.try_divide(F.col("close"), lag("close"))
    near = F.get(F.filter(F.array(*map(F.lit, SPLITS)), lambda s: F.abs(F.col("r") - s) / s < tolerance), 0)
    found = bars.select("symbol", "ts", r.alias("r")).where(F.abs(F.col("r") - 1) >= jump).withColumn("s", near).where("s IS NOT NULL")
    label = F.when(F.col("s") >= 1, F.concat(F.round("s").cast("int").cast("string"), F.lit(":1"))).otherwise(F.concat(F.lit("1:"), F.round(1 / F.col("s")).cast("int").cast("string")))
    return found.select("symbol", "ts", F.round("r", 4).alias("ratio"), label.alias("label"))


def ticker(symbol: Column) -> Column:
    """The market's name of a symbol; text that can't be one raises an error."""
    upper = F.upper(F.trim(symbol))
    mapped = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv)), upper), upper)
    return F.when(mapped.rlike(r"^[A-Za-z0-9=^.\-]{1,20}$"), mapped).otherwise(F.raise_error(F.concat(F.lit("not a symbol: "), symbol)))


def symbol_category(symbol: Column, lists: dict[str, list[str]]) -> Column:
    """The list that holds the symbol, or a guess by its shape: forex, indices, else tech_stocks."""
    known = F.coalesce(*(F.when(symbol.isin(v), k) for k, v in lists.items())) if lists else F.lit(None)
    return F.coalesce(known, F.when(symbol.contains("USD") | symbol.contains("=X"), "forex").when(symbol.contains("^"), "indices").otherwise("tech_stocks"))
