"""Boosted trees on features, fold by fold, with the flags that a suspicious score raises."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Most trees, their depth and the learning rate of a full training (fixed values).
FULL = {"trees": 1000, "depth": 6, "rate": 0.05}


def train_and_score(rows: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 42, validation: str | None = None) -> DataFrame:
    """(label, predicted, part) of rows with `part` train or test, predicted by trees that were grown on train.

    Features without a value (null or NaN) count as 0, in training and in scoring, so every row is scored; rows without a label have
    none to learn from, and are left out. `validation`: a boolean column; training rows where it is true only tell when to stop growing trees.
    """
    filled = rows.where(F.col(label).isNotNull()).withColumns({c: F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features})
    vectors = VectorAssembler(inputCols=features, outputCol="v").transform(filled.withColumn("label", F.col(label).cast("double")))
    trainer = GBTClassifier(featuresCol="v", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    if validation:
        trainer = trainer.setValidationIndicatorCol(validation)
    model = trainer.fit(vectors.where("part = 'train'"))
    return model.transform(vectors).select(F.col("label"), F.col("prediction").alias("predicted"), "part")


def cross_validate(rows: DataFrame, features: list[str], label: str, model: str = "boosted", **settings) -> DataFrame:
    """(model, fold, train, test): accuracies of trees trained afresh on each fold of rows with `fold` and `part`.

    Folds are few; each is trained by all tasks.
    """
    scores = None
    for fold in sorted(r.fold for r in rows.select("fold").distinct().collect()):
        scored = train_and_score(rows.where(F.col("fold") == fold), features, label, **settings)
        right = (F.col("label") == F.col("predicted")).cast("double")
        of = lambda p: F.avg(F.when(F.col("part") == p, right))  # noqa: B023, E731
        one = scored.agg(of("train").alias("train"), of("test").alias("test")).select(F.lit(model).alias("model"), F.lit(fold).alias("fold"), "train", "test")
        scores = one if scores is None else scores.unionByName(one)
    if scores is None:
        return rows.sparkSession.createDataFrame([], "model string, fold int, train double, test double")
    return scores


def accuracy_flags(scores: DataFrame, suspicious: float = 0.70, overfit: float = 1.5) -> DataFrame:
    """scores (train, test) with overfit ratio and flags: an accuracy too good to be true, or far better in training."""
    ratio = F.when(F.col("test") <= 0, float("inf")).otherwise(F.col("train") / F.col("test"))
    return scores.withColumn("overfit", ratio).withColumns({"suspicious": F.col("test") > suspicious, "overfitted": F.col("overfit") > overfit})


def prediction_action(prediction, classes: int):
    """The action of a class: 0 SELL, 1 BUY of two; 2 BUY, 0 SELL of three; else HOLD."""
    if classes == 2:
        return F.when(prediction == 1, "BUY").when(prediction == 0, "SELL").otherwise("HOLD")
    return F.when(prediction == 2, "BUY").when(prediction == 0, "SELL").otherwise("HOLD")
