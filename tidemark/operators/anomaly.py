"""Anomalies of each bar against the bars before it; the newest bar is what a live check asks about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import by_symbol, lag, trailing


def _zscore(c: str, n: int = 20) -> Column:
    before = trailing(n, 1)
    return F.try_divide(F.col(c) - F.avg(c).over(before), F.stddev_pop(c).over(before))


def anomalies(bars: DataFrame) -> DataFrame:
    """bars with volume_z, gap, volatility_ratio, spread_z, a level of each (null, MEDIUM, HIGH, CRITICAL), blocked, action, confidence.

    Windows are the 20 bars before; a deviation of 0 gives no score. Block or alert means HOLD with 0.9 or 0.3.
    """
    df = bars.withColumns({"_n": F.row_number().over(by_symbol()), "_ret": F.try_divide(F.col("close") - lag("close"), lag("close")), "_spread": F.try_divide(F.col("high") - F.col("low"), F.col("close"))})
    long, short = F.stddev_pop("_ret").over(by_symbol().rowsBetween(-20, -1)), F.stddev_pop("_ret").over(by_symbol().rowsBetween(-4, 0))
    df = df.withColumns({
        "volume_z": F.when((F.col("_n") >= 30) & (F.col("volume") != 0), _zscore("volume")),
        "gap": F.abs(F.try_divide(F.col("open") - lag("close"), lag("close"))),
        "volatility_ratio": F.when(F.col("_n") >= 22, F.try_divide(short, long)),
        "spread_z": F.when(F.col("_n") >= 20, _zscore("_spread")),
    })
    df = df.withColumns({
        "volume_level": F.when(F.abs("volume_z") > 5, "HIGH").when(F.abs("volume_z") > 3, "MEDIUM"),
        "gap_level": F.when(F.col("gap") > 0.05, "CRITICAL").when(F.col("gap") > 0.03, "HIGH").when(F.col("gap") > 0.02, "MEDIUM"),
        "volatility_level": F.when(F.col("volatility_ratio") > 4, "CRITICAL").when(F.col("volatility_ratio") > 3, "HIGH").when(F.col("volatility_ratio") > 2.5, "MEDIUM"),
        "spread_level": F.when(F.col("spread_z") > 4, "HIGH").when(F.col("spread_z") > 3, "MEDIUM"),
    })
    alerts = F.array_compact(F.array("volume_level", "gap_level", "volatility_level", "spread_level"))
    blocked = F.coalesce(F.col("volume_level") == "HIGH", F.lit(False)) | F.coalesce(F.col("gap_level") == "CRITICAL", F.lit(False)) | F.coalesce(F.col("volatility_level") == "CRITICAL", F.lit(False))
    df = df.withColumn("blocked", blocked).withColumn("alerts", F.size(alerts).cast("long"))
    return df.withColumns({"action": F.lit("HOLD"), "confidence": F.when(F.col("blocked"), 0.9).when(F.col("alerts") > 0, 0.3).otherwise(0.0)}).drop("_n", "_ret", "_spread")


def data_quality(bars: DataFrame, share: float = 0.10) -> DataFrame:
    """symbol, missing_close, missing_volume (shares), level and blocked: more than `share` missing is HIGH."""
    missing = lambda c: F.avg((F.col(c).isNull() | F.isnan(c)).cast("double"))
    out = bars.groupBy("symbol").agg(missing("close").alias("missing_close"), missing("volume").alias("missing_volume"))
    bad = (F.col("missing_close") > share) | (F.col("missing_volume") > share)
    return out.withColumns({"level": F.when(bad, "HIGH"), "blocked": bad})
