"""The desk, loads, grids, walks and searches, against loops and known values."""

import datetime as dt
import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import alerts, backtest, desk, features, learn, manifest, retrieval, signals, splits
from tidemark.operators import text as docs
from tidemark.plans.queries import LIBRARY, QUERIES
from tidemark.sources import bars as B
from tidemark.sources import files, reports

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bars(spark):
    rng, out = random.Random(5), []
    for symbol in ("AAA", "BBB", "CCC"):
        price = 100.0
        for i in range(400):
            price *= 1 + rng.gauss(0, 0.01)
            out.append((symbol, dt.datetime(2025, 1, 1) + dt.timedelta(hours=i), price, price * 1.01, price * 0.99, price, float(rng.randrange(1000, 9999))))
    return spark.createDataFrame(pd.DataFrame(out, columns=["symbol", "ts", "open", "high", "low", "close", "volume"])).withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()


def test_load_of_several_symbols(spark, tmp_path):
    (tmp_path / "AAA_1H.csv").write_text("<date>,<open>,<high>,<low>,<close>,<tickvol>\n".replace("<date>", "date") + "2025-01-01 00:00:00,1,2,0.5,1.5,10\n2025-01-01 00:00:00,1,2,0.5,1.6,11\n2025-01-01 01:00:00,,,,,\n2025-01-01 02:00:00,-1,2,0.5,1,5\n2025-01-01 03:00:00,3,4,2,3.5,x\n2025-01-09 00:00:00,1,1,1,1,1\n")
    (tmp_path / "BBB_1H.jsonl").write_text('{"time": "2025-01-01 00:00:00", "o": 5, "h": 6, "l": 4, "c": 5, "v": 1}\nnot json\n')
    index = files.scan(spark, str(tmp_path)).withColumn("key", files.file_key(F.col("path")))
    got = B.load(spark, index, ["AAA", "BBB", "ZZZ"], "1h", end="2025-01-05")
    rows = sorted((r.symbol, r.ts.hour, r.close, r.volume) for r in got.collect())
    assert rows == [("AAA", 0, 1.6, 11.0), ("AAA", 3, 3.5, None), ("BBB", 0, 5.0, 1.0)]
    assert B.load(spark, index, ["ZZZ"], "1h").count() == 0
    assert {r.symbol for r in files.listed_symbols(index).collect()} == {"AAA", "BBB"}


def test_relevance_looks_at_the_stem_with_spaces(spark):
    paths = {"/x/Order_Flow_Basics.pdf": True, "/x/order-flow.pdf": True, "/x/cooking.pdf": False}
    df = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("r", T.is_relevant(F.col("path")))
    assert any(" " in w for w in T.RELEVANT) and {r.path: r.r for r in df.collect()} == paths


def test_nearest_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (300, 6)).astype(float)
    v[7] = v[20] = v[41]
    v[3] = 0
    frame = spark.createDataFrame([(i, v[i].tolist()) for i in range(300)] + [(900, None)], "vec_id long, embedding array<double>").repartition(7)
    asked = frame.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.similarity, 9)) for r in retrieval.nearest(asked, frame, 5).collect()}
    with np.errstate(invalid="ignore"):
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 300, 20):
        s = np.round(u @ u[q], 12)
        best = sorted((i for i in range(300) if not np.isnan(s[i])), key=lambda i: (-s[i], i))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, round(s[i], 9)) for i in best]
    assert retrieval.nearest(asked.limit(0), frame, 5).count() == 0


def test_grid_has_a_row_for_every_job(spark, bars):
    jobs = spark.createDataFrame([("AAA", "macd"), ("BBB", "ma_cross"), ("none", "macd"), ("AAA", "strange")], "symbol string, strategy string")
    got = {(r.symbol, r.strategy_name): r for r in desk.backtest_grid(bars, jobs, ["macd", "ma_cross"]).collect()}
    assert {k: r.error for k, r in got.items()} == {("AAA", "macd"): None, ("BBB", "ma_cross"): None, ("none", "macd"): "no_data", ("AAA", "strange"): "unknown strategy: strange"}
    assert len(next(iter(got.values()))) == 13
    alone = backtest.report(signals.macd_histogram(bars.where("symbol = 'AAA'"))).head()
    assert got["AAA", "macd"].total_trades == alone.n_trades and got["AAA", "macd"].sharpe_ratio == pytest.approx(alone.sharpe)


def test_report_counts_the_trades_that_happened(bars):
    s = signals.signals(bars, ["macd", "ma_cross"])
    report = {(r.symbol, r.strategy): r for r in backtest.report(s).collect()}
    stats = {(r.symbol, r.strategy): r for r in backtest.trade_stats(backtest.trades_of(backtest.simulate(s))).collect()}
    assert len(report) == 6 and stats
    for key, r in stats.items():
        for c in ("n_trades", "n_wins", "win_rate", "profit_factor", "mean_win_pct", "mean_loss_pct", "commission", "mean_hold"):
            assert report[key][c] == pytest.approx(r[c]), (key, c)


def test_walk_forward_windows_are_backtests_of_their_rows(bars):
    """Windows by a loop over rows: 60 % to train at first, steps of a tenth; indicators begin anew in each part, whatever the drawdown."""
    got = {(r.symbol, r.strategy, r.window): r for r in desk.walk_forward(bars, ["macd", "ma_cross"]).collect()}
    own = bars.where("symbol = 'BBB'").toPandas().sort_values("ts")
    n = len(own)
    first, step = int(n * 0.6), max(1, int(n * 0.1))
    want = [(k, first + k * step, min(first + (k + 1) * step, n)) for k in range(5) if first + k * step < n and min(first + (k + 1) * step, n) - first - k * step >= 10]
    assert sorted(got) == sorted((s, x, k) for s in ("AAA", "BBB", "CCC") for x in ("ma_cross", "macd") for k, *_ in want) and len(want) == 4
    spark = bars.sparkSession
    for k, cut, end in want[1:3]:
        for low, high, name in ((0, cut, "train_sharpe"), (cut, end, "test_sharpe")):
            part = spark.createDataFrame(own.iloc[low:high]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
            assert got["BBB", "macd", k][name] == pytest.approx(backtest.report(signals.macd_histogram(part), backtest.Settings(max_drawdown=1.0)).head().sharpe)
    short = bars.where("ts < '2025-01-03'")  # a tenth of these is less than ten rows
    assert desk.walk_forward(short, ["macd"]).count() == 0 < desk.walk_forward(short, ["macd"], least=1).count()
    odd = bars.where("symbol = 'AAA'").withColumn("symbol", F.lit("A|1|B"))
    assert {r.symbol for r in desk.walk_forward(odd, ["macd"]).collect()} == {"A|1|B"}
    report = desk.walk_forward_report(bars, ["macd"]).where("symbol = 'BBB'").head()
    sharpes = [(got["BBB", "macd", k].train_sharpe, got["BBB", "macd", k].test_sharpe) for k, *_ in want]
    ratios = [min(a / b, 10.0) for a, b in sharpes if b != 0]
    assert report.overfit == pytest.approx(np.mean(ratios) if ratios else 0.0)


def test_load_keeps_the_last_sound_row(spark, tmp_path):
    """Impossible rows go before repeated times do, so a good bar isn't lost to a bad one that came after it; prices are adjusted first."""
    lines = ["Date,Open,High,Low,Close,Adj Close,Volume", "2025-01-01 00:00:00,10,11,9,10,5,100", "2025-01-01 01:00:00,10,12,9,10,5,100", "2025-01-01 01:00:00,10,8,9,10,5,100",
             "2025-01-01 02:00:00,10,12,9,10,5,100", "2025-01-01 02:00:00,10,12,9,11,5.5,100", "2025-01-01 03:00:00,,,,,,", "2025-01-01 04:00:00,0,1,0,1,1,1"]
    (tmp_path / "aaa_1h.csv").write_text("\n".join(lines))
    (tmp_path / "bbb_1h.jsonl").write_text('{"time": "2025-01-01 00:00:00", "o": 1, "h": 2, "l": 1, "c": 2, "v": 3}\n')
    index = spark.createDataFrame([(f"{tmp_path}/aaa_1h.csv", "AAA_1H", "csv"), (f"{tmp_path}/bbb_1h.jsonl", "BBB_1H", "jsonl")], "path string, key string, ext string")
    tell = lambda df: [(r.symbol, r.ts.hour, r.high, r.close, r.volume) for r in df.orderBy("symbol", "ts").collect()]
    adjusted = [("aaa", 0, 5.5, 5.0, 200.0), ("aaa", 1, 6.0, 5.0, 200.0), ("aaa", 2, 6.0, 5.5, 200.0)]
    assert tell(B.load(spark, index, ["aaa", "bbb", "none"], "1h")) == adjusted + [("bbb", 0, 2.0, 2.0, 3.0)]
    assert tell(B.load(spark, index, ["aaa"], "1h", adjusted=False)) == [("aaa", 0, 11.0, 10.0, 100.0), ("aaa", 1, 12.0, 10.0, 100.0), ("aaa", 2, 12.0, 11.0, 100.0)]
    assert tell(B.load(spark, index, ["aaa"], "1h", "2025-01-01 01:00:00", "2025-01-01 01:00:00")) == adjusted[1:2]
    raw = spark.createDataFrame([("2025-01-01 05:00:00", 1.0, 1.0, 1.0, 1.0, 1.0)], "timestamp string, open double, high double, low double, close double, volume double")
    assert tell(B.load(spark, index, ["none", "bbb"], "1h", fallback=lambda s, t: raw if s == "none" else None)) == [("bbb", 0, 2.0, 2.0, 3.0), ("none", 5, 1.0, 1.0, 1.0)]
    assert B.load(spark, index, ["none"], "1h").count() == 0


def test_cutoff_is_the_row_at_four_fifths(spark):
    rows = [(dt.datetime(2025, 1, 1) + dt.timedelta(hours=7 * i // 3),) for i in range(101)]
    out = splits.temporal_split(spark.createDataFrame(rows, "ts timestamp"), gap="0 hours")
    cutoff = sorted(r[0] for r in rows)[int(0.8 * 101)]
    assert out.where("part = 'test'").agg(F.min("ts")).head()[0] == cutoff and out.count() == 101


def test_paper_scan_in_order(spark):
    accounts = spark.createDataFrame([("a", 1000.0, 1000.0), ("b", 100.0, 1000.0)], "account string, cash double, peak double")
    held = spark.createDataFrame([("a", "S1", "LONG", 10.0, 5.0, 0.02, 0.04), ("a", "S2", "SHORT", 10.0, 5.0, 0.02, 0.04), ("a", "S9", "LONG", 10.0, 1.0, 0.02, 0.04)], "account string, symbol string, side string, entry_price double, quantity double, stop_loss double, take_profit double")
    prices = spark.createDataFrame([("S1", 9.0), ("S2", 9.9), ("S3", 2.0), ("S4", 4.0)], "symbol string, price double")
    wanted = spark.createDataFrame([(x, s, "BUY" if s != "S4" else "SELL", True, 0.5) for x in "ab" for s in ("S1", "S2", "S3", "S4", "S8")], "account string, symbol string, action string, approved boolean, position_size double")
    after, left, trades = desk.paper_scan(accounts, held, prices, wanted)
    got = {(r.account, r.symbol, r.event): (r.side, round(r.quantity, 6), round(r.pnl, 6)) for r in trades.collect()}
    # S1 stops at 9; then S1, S3, S4 open for a tenth each of what is left, S2 is still held, S8 has no price; b is far below its peak
    cash = 1000 + 45
    assert got == {("a", "S1", "stop_loss"): ("LONG", 5.0, -5.0), ("a", "S1", "open"): ("LONG", round(cash * 0.1 / 9, 6), 0.0), ("a", "S3", "open"): ("LONG", round(cash * 0.9 * 0.1 / 2, 6), 0.0), ("a", "S4", "open"): ("SHORT", round(cash * 0.81 * 0.1 / 4, 6), 0.0)}
    assert {r.account: round(r.cash, 6) for r in after.collect()} == {"a": round(cash * 0.81, 6), "b": 100.0}
    now = {(r.account, r.symbol): (r.side, r.entry_price, r.stop_loss) for r in left.collect()}
    assert now == {("a", "S2"): ("SHORT", 10.0, 0.02), ("a", "S9"): ("LONG", 10.0, 0.02), ("a", "S1"): ("LONG", 9.0, 0.02), ("a", "S3"): ("LONG", 2.0, 0.02), ("a", "S4"): ("SHORT", 4.0, 0.02)}


def test_watcher_sees_newest_bars_only(spark, bars):
    rules = alerts.default_rules(spark)
    every, newest = desk.strategy_alerts(bars, ["macd"], rules), desk.strategy_alerts(bars, ["macd"], rules, last_only=True)
    assert every.count() > 0 and newest.where("ts < '2025-01-17 15:00:00'").count() == 0


def test_titles_find_their_books(spark):
    got = {r.title: r.book for r in manifest.match_titles(spark.createDataFrame([("cold widget",), ("large bolt",), ("zzzzzz",), ("rod",)], "title string"), LIBRARY).collect()}
    assert got == {"cold widget": "the cold widgets", "large bolt": "large bolts"}
    assert QUERIES["manifest_titles"](spark, SF).count() >= 10


def test_search_holds_few_similarities_at_once():
    """A full batch meets a full block of queries in bounded memory (one product of both took 1.3 GB), whatever came in the batches before."""
    gen = np.random.default_rng(8)
    v, block = gen.integers(-2, 3, size=(10_000, 8)).astype(float), retrieval._units(gen.normal(size=(retrieval.BLOCK, 8)))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(i, 10_000, 2)[::-1]), pa.array(v[i::2][::-1].tolist())], names=["vec_id", "v"]) for i in (0, 1)]
    best, found = np.full((len(block), 3), -np.inf), {}
    tracemalloc.start()
    for batch in batches:
        for out in retrieval._best(batch, pa.array(np.arange(len(block))), block, best):
            for q, i, x in zip(*(c.to_pylist() for c in out.columns)):
                found.setdefault(q, []).append((-x, i))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    for q in range(0, len(block), 97):
        s = np.round(retrieval._units(v) @ block[q], 12)
        s[np.isnan(s)] = -np.inf
        assert [i for _, i in sorted(found[q])[:3]] == np.argsort(-s, kind="stable")[:3].tolist()


def test_topics_of_the_nearest_directory(spark):
    topics = spark.createDataFrame([("gann", "gann"), ("rsi", "rsi")], "name string, topic string")
    paths = {"Gann/ RSI /a.pdf": "rsi", "/gann/x/b.pdf": "gann", "other/c.pdf": None, "gann/1/2/3/d.pdf": None, "e.pdf": None}
    got = manifest.directory_topics(spark.createDataFrame([(p,) for p in paths] * 2, "path string"), topics)
    assert got.count() == 10 and {r.path: r.topic for r in got.collect()} == paths


def test_silhouette_and_early_stop(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(c, 0.1, (30, 4)) for c in (0, 5, 9)])
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    good = spark.createDataFrame([(i, i // 30) for i in range(90)], "vec_id long, cluster_id int")
    bad = spark.createDataFrame([(i, i % 3) for i in range(90)], "vec_id long, cluster_id int")
    assert retrieval.silhouette(good, vectors) > 0.9 > 0.1 > retrieval.silhouette(bad, vectors)
    rows = spark.createDataFrame([(float(x), float(rng.normal()), int(x > 0), "train" if i % 4 else "test", i % 8 == 1) for i, x in enumerate(rng.normal(size=400))], "a double, b double, y int, part string, val boolean")
    scored = learn.train_and_score(rows, ["a", "b"], "y", trees=8, depth=2, validation="val")
    assert scored.where("part = 'test'").agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).head()[0] > 0.9
    bars = spark.createDataFrame([("A", dt.datetime(2025, 1, 1), 1.0, 2, "x", 1)], "symbol string, ts timestamp, rsi double, n int, name string, price_up int")
    assert features.feature_columns(bars) == ["rsi", "n"]


def test_sinks(spark, bars, tmp_path):
    rows = spark.createDataFrame([(i, "x" if i % 3 else "y", ("train", "val", "test")[i % 3]) for i in range(30)], "id long, label string, part string")
    manifest.write_splits(rows, f"{tmp_path}/splits")
    back = spark.read.option("header", True).csv(f"{tmp_path}/splits")
    assert back.count() == 30 and back.where("part = 'val'").count() == 10
    text = reports.catalog_report(rows, ["label"], f"{tmp_path}/catalog")
    assert "30 rows" in text and "| x | 20 |" in text and spark.read.json(f"{tmp_path}/catalog").count() == 30
    cues = docs.subtitles(spark.createDataFrame([("a", "1\n00:00:01,000 --> 00:00:02,500\nhello you\n")], "path string, content string"))
    reports.write_transcripts(cues, docs.transcripts(cues), f"{tmp_path}/transcripts")
    index = spark.read.option("header", True).csv(f"{tmp_path}/transcripts/index").head()
    assert (index.path, index.words, index.duration_s) == ("a", "2", "2.5") and spark.read.json(f"{tmp_path}/transcripts/cues").count() == 1
    report = backtest.report(signals.macd_histogram(bars))
    page, table = reports.html_page(report, ["symbol", "sharpe"], "<t>"), reports.markdown(report, ["symbol", "sharpe"])
    assert "&lt;t&gt;" in page and page.count("<tr>") == 4 and table.count("\n") == 4
    reports.write_json(report, backtest.simulate(signals.macd_histogram(bars)).select("symbol", "strategy", "ts", "equity"), f"{tmp_path}/json", most=100)
    assert spark.read.json(f"{tmp_path}/json/metrics").count() == 3 and spark.read.json(f"{tmp_path}/json/curves").count() == 300


def test_histogram_counts_every_row(spark):
    rows = spark.createDataFrame([(v,) for v in (-1.0, -0.95, 0.0, 0.99, 1.0, 1.1, -7.0, None, float("nan"))], "v double")
    got = {r.bin: r.n for r in desk.histogram(rows, "v", -1.0, 1.0).collect()}
    assert got == {0: 2, 10: 1, 19: 2, 20: 1, -1: 1, None: 2}


def test_overview_of_each_symbol(spark, bars):
    got = {r.symbol: r for r in desk.overview(bars).collect()}
    own = bars.where("symbol = 'BBB'").toPandas().sort_values("ts")
    assert set(got) == {"AAA", "BBB", "CCC"} and got["BBB"].pct == pytest.approx((own.close.iloc[-1] / own.close.iloc[0] - 1) * 100)
    zero = bars.where("symbol = 'AAA'").withColumn("close", F.lit(0.0))
    assert desk.overview(zero).head().pct is None and desk.overview(bars.where("false")).count() == 0
