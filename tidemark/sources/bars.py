"""Bar tables (symbol, ts, open, high, low, close, volume): from ticks, from coarser bars, from files of any usual shape."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.cleaning import SYNONYMS, adjust, between, drop_empty, keep_last, normalize_ohlcv, validate
from tidemark.sources import tolerant
from tidemark.sources.files import resolve

#: timeframe -> (interval, period) of market-data requests (fixed values).
TIMEFRAMES = {"1m": ("1m", "7d"), "2m": ("2m", "60d"), "5m": ("5m", "60d"), "15m": ("15m", "60d"), "30m": ("30m", "60d"), "1h": ("1h", "730d"), "4h": ("1h", "730d"), "1d": ("1d", "max"), "1wk": ("1wk", "max")}
DEFAULT_REQUEST = ("1h", "730d")


def request_of(timeframe: Column) -> Column:
    """struct<interval, period> that a market-data request for a timeframe asks for."""
    known = F.create_map(*(F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("interval"), F.lit(x[1]).alias("period")) for kv in TIMEFRAMES.items() for x in kv))
    return F.coalesce(F.element_at(known, timeframe), F.struct(F.lit(DEFAULT_REQUEST[0]).alias("interval"), F.lit(DEFAULT_REQUEST[1]).alias("period")))


def bars_from_ticks(ticks: DataFrame, symbol: Column, price: Column, bucket: Column, order: list[str]) -> DataFrame:
    """One bar per symbol and bucket: first, highest, lowest, last price, number of ticks. `order`: columns that order ticks."""
    keyed = ticks.select(symbol.alias("symbol"), bucket.alias("bucket"), price.cast("double").alias("price"), F.struct(*order).alias("at"))
    return (
        keyed.groupBy("symbol", "bucket")
        .agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.count("*").cast("double").alias("volume"))
        .withColumnRenamed("bucket", "ts")
    )


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: the event type is the symbol, an hour the bucket."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    return bars_from_ticks(events, F.col("event_type"), F.col("value"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), ["ts", "event_id"])


def daily_order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ticks: the priority is the symbol, a day the bucket."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    return bars_from_ticks(orders, F.col("o_orderpriority"), F.col("o_totalprice"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz"), ["o_orderdate", "o_orderkey"])


def resample(bars: DataFrame, every: str) -> DataFrame:
    """Coarser bars: `every` is "4 hours", "1 day", ... aligned to the epoch; buckets without bars have no row."""
    start = F.window(F.col("ts"), every)["start"].cast("timestamp_ntz")
    return bars.groupBy("symbol", start.alias("bucket")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("bucket", "ts").dropna(subset=["open", "high", "low", "close"])


def read_bars(spark: SparkSession, path: str, kind: str, symbol: str) -> DataFrame:
    """Bars of one symbol from a CSV, JSON, JSONL or Parquet path, columns under any of their usual names.

    JSON may be an array, nested, one flat object or lines; what is no record is left out here and listed by `json_rejects`.
    """
    if kind == "csv":
        raw = spark.read.option("header", True).csv(path)
    elif kind == "parquet":
        raw = spark.read.parquet(path)
    elif kind in ("json", "jsonl"):
        read = tolerant.read_json(spark, path)
        # the first name that a record has, in the order of preference
        picked = {n: F.coalesce(*(F.try_element_at("record", F.lit(x)) for x in names)) for n, names in SYNONYMS.items()}
        raw = tolerant.records(read).select(*(c.alias(n) for n, c in picked.items()))
    else:
        raise ValueError(f"unknown format: {kind}")
    return normalize_ohlcv(raw.withColumn("symbol", F.lit(symbol)))


def json_rejects(spark: SparkSession, path: str) -> DataFrame:
    """path, place, reject: what in JSON or JSONL files is no record."""
    return tolerant.rejects(tolerant.read_json(spark, path))


def read_or_none(spark: SparkSession, path: str, kind: str, symbol: str) -> DataFrame | None:
    """`read_bars`, or None with a warning where the format is unknown or Spark finds nothing that it can read."""
    try:
        return read_bars(spark, path, kind, symbol)
    except (ValueError, AnalysisException) as problem:
        warnings.warn(f"{path} can't be read as bars: {str(problem).splitlines()[0]}", stacklevel=2)
        return None


def load(
    spark: SparkSession,
    index: DataFrame,
    symbols: list[str],
    timeframe: str,
    start: str | None = None,
    end: str | None = None,
    adjusted: bool = True,
    fallback: Callable[[str, str], DataFrame | None] | None = None,
) -> DataFrame:
    """Clean bars of several symbols from the files that an index (path, key, ext) resolves them to.

    Each file's bars are normalised and cut to the range of times; prices are adjusted for splits and dividends where the file has
    adjusted closes (unless `adjusted` is False); impossible rows go; of repeated times the last row that is left stays; rows
    without any price or volume go. A symbol without a file that can be read has the rows that `fallback` (symbol, timeframe) gives, in any of the usual
    columns, or none. The list of symbols is made by hand.
    """
    parts = []
    for symbol in symbols:
        found = resolve(index, symbol, timeframe).head()
        if found and (bars := read_or_none(spark, found.path, found.ext, symbol)) is not None:
            pass
        elif fallback is not None and (raw := fallback(symbol, timeframe)) is not None:
            bars = normalize_ohlcv(raw.withColumn("symbol", F.lit(symbol)))
        else:
            continue
        parts.append(bars.withColumn("seq", F.monotonically_increasing_id()))
    if not parts:
        return spark.createDataFrame([], "symbol string, open double, high double, low double, close double, volume double, ts timestamp_ntz")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    out = between(out, start, end)
    if adjusted and "adj_close" in out.columns:
        out = adjust(out)
    return drop_empty(keep_last(validate(out))).drop("seq")


def write_features(features: DataFrame, path: str) -> None:
    """Features by symbol, so that a reader of one symbol reads one folder."""
    features.repartition("symbol").write.mode("overwrite").partitionBy("symbol").parquet(path)


def read_features(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("symbol").isin(symbols)) if symbols else df
