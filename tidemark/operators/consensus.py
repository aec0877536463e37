"""Votes of many agents to one decision: weights, consensus, risk gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: agent -> (weight, factor of its category); others have weight 0.1, factor 1 (fixed values).
WEIGHTS = {"ml": (0.35, 2.0), "knowledge": (0.25, 1.0), "news": (0.15, 1.0), "security": (0.05, 1.0), "learner": (0.10, 0.0)}
THRESHOLD = 0.60


def direction(recommendation: Column) -> Column:
    return F.when(recommendation == "BUY", 1.0).when(recommendation == "SELL", -1.0).otherwise(0.0)


def usable(votes: DataFrame) -> DataFrame:
    """Votes without those of stubs and without a recommendation or confidence."""
    return votes.where(F.coalesce(F.col("status") != "NOT_IMPLEMENTED", F.lit(True)) & F.col("recommendation").isin("BUY", "SELL", "HOLD") & F.col("confidence").isNotNull())


def consensus(votes: DataFrame) -> DataFrame:
    """decision_id, consensus in [-1, 1] (0 without weight), n_votes."""
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for a, (w, m) in WEIGHTS.items() for x in (a, w * m))), F.col("agent")), F.lit(0.1))
    weighed = votes.withColumns({"_w": weight, "_s": weight * F.col("confidence") * direction(F.col("recommendation"))})
    return weighed.groupBy("decision_id").agg(F.coalesce(F.try_divide(F.sum("_s"), F.sum("_w")), F.lit(0.0)).alias("consensus"), F.count("*").alias("n_votes"))


def kelly(win_rate: Column, avg_win: Column, avg_loss: Column, trades: Column, fraction: float = 0.25) -> Column:
    """Fractional Kelly size, half of it below 30 trades, 0.01 without any, 0 without losses or an edge."""
    b = F.try_divide(avg_win, avg_loss)
    raw = F.greatest(F.lit(0.0), fraction * F.try_divide(b * win_rate - (1 - win_rate), b))
    return F.when(trades == 0, 0.01).when(avg_loss == 0, 0.0).otherwise(F.coalesce(raw, F.lit(0.0)) * F.when(trades < 30, 0.5).otherwise(1.0))


def decide(scores: DataFrame, size: Column, cap: float = 0.02) -> DataFrame:
    """Action by the threshold, then the risk gate: position size, stops that widen with doubt, approval."""
    c = F.abs("consensus")
    action = F.when(F.col("consensus") >= THRESHOLD, "BUY").when(F.col("consensus") <= -THRESHOLD, "SELL").otherwise("HOLD")
    df = scores.withColumn("proposed", action)
    position = F.when(F.col("proposed") == "HOLD", 0.0).otherwise(F.round(F.least(size * c, F.lit(cap)), 6))
    df = df.withColumns({"position_size": position, "stop_loss": F.round(0.02 * (2 - c), 4), "take_profit": F.round(0.04 * (1 + c), 4)})
    df = df.withColumn("approved", (F.col("proposed") == "HOLD") | (F.col("position_size") > 0.001))
    return df.withColumn("action", F.when(F.col("approved"), F.col("proposed")).otherwise("HOLD"))


def ensemble(predictions: DataFrame) -> DataFrame:
    """Models' predictions to one action: sums of accuracy * confidence by action; ties go to BUY, then SELL. Accuracy that is no number: 0.5."""
    accuracy = F.coalesce(F.col("accuracy").cast("string").try_cast("double"), F.lit(0.5))
    sums = {a: F.sum(F.when(F.col("action") == a, accuracy * F.col("confidence")).otherwise(0.0)).alias(a) for a in ("BUY", "SELL", "HOLD")}
    out = predictions.groupBy("decision_id").agg(*sums.values(), F.sum(accuracy).alias("weight"))
    best = F.greatest("BUY", "SELL", "HOLD")
    return out.select("decision_id", F.when(F.col("BUY") == best, "BUY").when(F.col("SELL") == best, "SELL").otherwise("HOLD").alias("action"), F.coalesce(F.try_divide(best, F.col("weight")), F.lit(0.0)).alias("confidence"))
