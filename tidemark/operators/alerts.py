"""Alert rules over signals, with a cooldown in event time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "rule string, level string, min_score double, min_confidence double, cooldown_s long, signal string, symbols array<string>"
#: Default rules (fixed values).
DEFAULT = [("strong_signal", "WARNING", 0.50, 0.40, 300, None, None), ("critical_signal", "CRITICAL", 0.75, 0.60, 120, None, None), ("any_signal", "INFO", 0.30, 0.0, 60, None, None)]


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT, RULES)


def matches(signals: DataFrame, rules: DataFrame) -> DataFrame:
    """Signals (symbol, ts, signal, score, confidence) and the rules they meet; a score of 0 or null is the confidence."""
    scored = signals.withColumn("score", F.coalesce(F.nullif(F.col("score"), F.lit(0.0)), F.col("confidence"))).alias("s")
    r = rules.alias("r")
    on = (F.abs("s.score") >= F.col("r.min_score")) & (F.col("s.confidence") >= F.col("r.min_confidence")) & (F.col("r.signal").isNull() | (F.col("r.signal") == F.col("s.signal"))) & (F.col("r.symbols").isNull() | F.array_contains("r.symbols", F.col("s.symbol")))
    # rules are few and written by hand; the join is by their conditions
    return scored.where("signal <> 'HOLD'").join(r, on).select("s.symbol", "s.ts", "s.signal", "s.score", "s.confidence", "r.rule", "r.level", "r.cooldown_s")


def cool_down(found: DataFrame) -> DataFrame:
    """Alerts of a rule and symbol at least its cooldown after the last one that was kept."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)

    def kept(frame: pd.DataFrame) -> pd.DataFrame:
        frame, last, keep = frame.sort_values(["ts", "signal"], kind="stable"), None, []
        for ts, wait in zip(frame["ts"], frame["cooldown_s"]):
            keep.append(last is None or (ts - last).total_seconds() >= wait)
            last = ts if keep[-1] else last
        return frame[keep]

    return found.groupBy("rule", "symbol").applyInPandas(kept, schema)


def host_allowed(url: str, hosts: tuple[str, ...]):
    """True where a https URL's host is one of `hosts` or below it."""
    host = F.try_parse_url(F.col(url), F.lit("HOST"))
    below = F.lit(False)
    for h in hosts:
        below = below | (host == h) | F.endswith(host, F.lit("." + h))
    return F.coalesce(F.startswith(F.col(url), F.lit("https://")) & below, F.lit(False))
