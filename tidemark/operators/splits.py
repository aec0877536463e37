"""Splits in time, folds, strata, and their metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def temporal_split(df: DataFrame, share: float = 0.8, gap: str = "5 days") -> DataFrame:
    """df with `part`: train before the cutoff, test from `gap` after it; between: neither.

    The cutoff is the time of the row number floor(share * n), from 0, in time order, exact at any size: rows are counted
    by time, and only the counts are ordered.
    """
    counted = df.groupBy("ts").agg(F.count("*").alias("n"))
    days = counted.groupBy(F.to_date("ts").alias("day")).agg(F.sum("n").alias("n"))  # a row a day: a short list
    upto = days.withColumn("upto", F.sum("n").over(Window.orderBy("day"))).withColumn("at", F.floor(share * F.sum("n").over(Window.orderBy(F.lit(0)))))
    day = upto.where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at"))).select("day", (F.col("at") - F.col("upto") + F.col("n")).alias("left"))
    inside = counted.join(F.broadcast(day), F.to_date("ts") == F.col("day")).withColumn("upto", F.sum("n").over(Window.orderBy("ts")))
    cutoff = inside.where("upto > left").agg(F.min("ts").alias("cutoff"))  # one row
    part = F.when(F.col("ts") < F.col("cutoff"), "train").when(F.col("ts") >= F.col("cutoff") + F.expr(f"interval {gap}"), "test")
    return df.crossJoin(F.broadcast(cutoff)).withColumn("part", part).where("part IS NOT NULL").drop("cutoff")


@dataclass(frozen=True)
class Fold:
    fold: int
    train_start: int
    train_end: int
    test_start: int
    test_end: int


def plan_folds(n: int, folds: int = 5, test: int = 0, least: int = 0, gap: int = 0, sliding: bool = False) -> list[Fold]:
    """Folds over n rows in time order: training grows (or slides), tests follow at equal steps, `gap` rows between."""
    test, least = test or n // (folds + 1), least or n // (folds + 1)
    if folds < 2 or test < 1 or least < 1 or least + gap + test > n:
        raise ValueError("too few rows for these folds")
    step, out = max(1, (n - least - gap - test) // (folds - 1)), []
    for k in range(folds):
        end = least + k * step
        if end + gap + test > n:
            break
        out.append(Fold(k, end - least if sliding else 0, end, end + gap, end + gap + test))
    return out


def assign_folds(spark: SparkSession, df: DataFrame, folds: list[Fold], by: str = "symbol") -> DataFrame:
    """Rows of df once for each fold and part they are in, numbered in time within `by`."""
    numbered = df.withColumn("_row", F.row_number().over(Window.partitionBy(by).orderBy("ts")) - 1)
    table = spark.createDataFrame([(f.fold, p, a, b) for f in folds for p, a, b in (("train", f.train_start, f.train_end), ("test", f.test_start, f.test_end))], "fold int, part string, _low long, _high long")
    return numbered.join(F.broadcast(table), (F.col("_row") >= F.col("_low")) & (F.col("_row") < F.col("_high"))).drop("_row", "_low", "_high")


def assign_own_folds(df: DataFrame, folds: int = 5, gap: int = 0, by: str = "symbol") -> DataFrame:
    """As `assign_folds`, each series of `by` with the plan of its own length: `plan_folds(n, folds, gap=gap)`; series too short for it have no folds."""
    w = Window.partitionBy(by)
    numbered = df.withColumns({"_row": F.row_number().over(w.orderBy("ts")) - 1, "_n": F.count("*").over(w)})
    size = F.floor(F.col("_n") / (folds + 1))
    step = F.greatest(F.lit(1), F.floor((F.col("_n") - 2 * size - gap) / (folds - 1)))
    ends = [(k, size + k * step) for k in range(folds)]
    parts = F.array(*(F.struct(F.lit(k).alias("fold"), F.lit(p).alias("part"), low.alias("low"), high.alias("high"), (end + gap + size).alias("last")) for k, end in ends for p, low, high in (("train", F.lit(0).cast("long"), end), ("test", end + gap, end + gap + size))))
    held = F.filter(parts, lambda f: (F.col("_row") >= f["low"]) & (F.col("_row") < f["high"]) & (f["last"] <= F.col("_n")))
    placed = numbered.where(size >= 1).withColumn("_fold", F.explode(held))
    return placed.select(*df.columns, "_fold.fold", "_fold.part")


def stratified_split(df: DataFrame, label: str, key: str, shares: tuple[float, float] = (0.7, 0.15), seed: int = 42) -> DataFrame:
    """df with `part` (train, val, test): within each label by rank of a hash; labels with fewer than 3 rows go."""
    w = Window.partitionBy(label)
    ranked = df.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy(F.xxhash64(key, F.lit(seed)), key)) - 1}).where("_n >= 3")
    at = F.col("_k") / F.col("_n")
    return ranked.withColumn("part", F.when(at < shares[0], "train").when(at < sum(shares), "val").otherwise("test")).drop("_n", "_k")


def fold_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, means and population deviations of train and test scores, overfit ratio (infinite without test score), flag above 1.5."""
    out = scores.groupBy(*by).agg(F.avg("train").alias("mean_train"), F.avg("test").alias("mean_test"), F.stddev_pop("test").alias("std_test"))
    ratio = F.when(F.col("mean_test") <= 0, float("inf")).otherwise(F.col("mean_train") / F.col("mean_test"))
    return out.withColumn("overfit", ratio).withColumn("overfitted", F.col("overfit") > 1.5)


def walk_forward_summary(windows: DataFrame, by: list[str]) -> DataFrame:
    """by, means of test Sharpe, return, win rate; stability max(1 - |sd / mean|, -1); overfit: mean of train / test Sharpe, 10 at most, over windows with a test Sharpe, 0 without any."""
    out = windows.groupBy(*by).agg(F.avg("test_sharpe").alias("mean_sharpe"), F.stddev_pop("test_sharpe").alias("_sd"), F.count("*").alias("_n"), F.avg("test_return").alias("mean_return"), F.avg("test_win_rate").alias("mean_win_rate"), F.coalesce(F.avg(F.when(F.col("test_sharpe") != 0, F.least(F.try_divide(F.col("train_sharpe"), F.col("test_sharpe")), F.lit(10.0)))), F.lit(0.0)).alias("overfit"))
    stability = F.when((F.col("_n") < 2) | (F.col("mean_sharpe") == 0), 0.0).otherwise(F.greatest(1 - F.abs(F.col("_sd") / F.col("mean_sharpe")), F.lit(-1.0)))
    return out.withColumn("stability", stability).withColumn("stable", F.col("stability") > 0.5).drop("_sd", "_n")


def classification_metrics(rows: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 (weighted by label, 0 where undefined) of (label, predicted)."""
    pairs = rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    labels = pairs.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    guessed = pairs.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    each = labels.join(guessed, "label", "left").withColumns({"p": F.coalesce(F.try_divide("hit", "guessed"), F.lit(0.0)), "r": F.try_divide("hit", "support")})
    each = each.withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return each.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), weighted("p").alias("precision"), weighted("r").alias("recall"), weighted("f").alias("f1"))
