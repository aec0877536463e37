"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark.plans.queries import QUERIES

HEADLINE = [
    "bars_hourly", "bars_4h", "features_sma", "features_momentum", "features_macd", "features_all", "signals_ma_cross", "signals_consensus", "anomaly_scores", "votes_decisions",
    "backtest_report", "metrics_curve", "join_asof_daily", "text_sentiment", "text_keywords", "text_chunks", "vectors_nearest", "vectors_zero_shot", "files_roll_up", "trade_costs",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # the session is up
    # the same work in every round, so that rounds on machines of unlike speed can be compared
    began = time.time()
    spark.range(200_000_000).selectExpr("sum(hash(id) % 7)").collect()
    reference = round(time.time() - began, 3)
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "reference_sec": reference, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
