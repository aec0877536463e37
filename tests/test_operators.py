"""Operators that SQL can't check, against slow loops and known values."""

import datetime as dt
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.windows import ema
from tidemark.operators import alerts, anomaly, backtest, cleaning, consensus, features, joins, manifest, portfolio, retrieval, signals, splits
from tidemark.operators import text as docs
from tidemark.plans.queries import ORACLE_SQL, QUERIES
from tidemark.sources import bars as B
from tidemark.sources import files
from tidemark.streaming import streams

START = dt.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def prices():
    rng, out, price = random.Random(3), [], 100.0
    for symbol in ("AAA", "BBB"):
        for i in range(260):
            price *= 1 + rng.gauss(0.0002, 0.01)
            out.append((symbol, START + dt.timedelta(hours=i), price * 0.999, price * 1.01, price * 0.99, price, float(rng.randrange(1000, 99999))))
    return pd.DataFrame(out, columns=["symbol", "ts", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="module")
def bars(spark, prices):
    return spark.createDataFrame(prices).withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()


def test_features_against_pandas(bars, prices):
    got = features.features(bars, fill=False).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    for symbol, g in prices.groupby("symbol"):
        mine, c = got[got.symbol == symbol].reset_index(drop=True), g.close.reset_index(drop=True)
        want = {"sma_20": c.rolling(20).mean(), "ema_50": c.ewm(span=50, adjust=False).mean(), "volatility_20": c.pct_change().rolling(20).std(), "bb_upper": c.rolling(20).mean() + 2 * c.rolling(20).std()}
        fast, slow = c.ewm(span=12, adjust=False).mean(), c.ewm(span=26, adjust=False).mean()
        want["macd_histogram"] = (fast - slow) - (fast - slow).ewm(span=9, adjust=False).mean()
        for name, series in want.items():
            pd.testing.assert_series_equal(mine[name], series, check_names=False, rtol=1e-9, atol=1e-9)


def test_filled_features_have_no_gaps(bars):
    df = features.features(bars)
    doubles = [c for c, t in df.dtypes if t == "double"]
    assert df.where(" OR ".join(f"{c} IS NULL OR isnan({c})" for c in doubles)).count() == 0


def test_obv_and_sessions(spark):
    rows = [("X", START + dt.timedelta(hours=i), 1.0, 2.0, 0.5, 100.0 + i, 100.0 * (i + 1)) for i in range(24)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    got = features.native_features(df).orderBy("ts").collect()
    assert [r.obv for r in got[:5]] == [0, 200, 500, 900, 1400]
    assert {r.hour for r in got if r.session_london} == set(range(8, 17)) and {r.hour for r in got if r.session_ny} == set(range(13, 22))


def test_crypto_needs_its_columns(bars):
    with pytest.raises(ValueError):
        features.crypto_features(bars)


def test_simulation_by_hand(spark):
    closes, acts = [100.0, 100.0, 110.0, 105.0, 90.0, 90.0], ["HOLD", "BUY", "HOLD", "SELL", "HOLD", "HOLD"]
    rows = [("X", "s", START + dt.timedelta(hours=i), c, 0.0, a, 0.5, 0.5, 0.1) for i, (c, a) in enumerate(zip(closes, acts))]
    df = spark.createDataFrame(rows, "symbol string, strategy string, ts timestamp_ntz, close double, volume double, signal string, stop_loss_pct double, take_profit_pct double, position_size double")
    steps = backtest.simulate(df)
    trades = backtest.trades_of(steps).orderBy("exit_ts").collect()
    assert [(t.side, t.reason) for t in trades] == [("LONG", "signal_reversal"), ("SHORT", "end_of_data")]
    entry, value = 100 * 1.0005, 10_000 - 10
    quantity, leave = value / entry, 105 * 0.9995
    assert trades[0].pnl == pytest.approx((leave - entry) * quantity - leave * quantity * 0.001)
    assert trades[0].hold_bars == 2 and steps.count() == 6
    final = steps.orderBy("ts").tail(1)[0].equity
    assert final == pytest.approx(100_000 + sum(t.pnl for t in trades) - 10 - (trades[1].commission - trades[1].quantity * trades[1].exit_price * 0.001))


def test_stops_and_breaker(spark):
    closes = [100.0, 100.0, 96.0, 100.0, 30.0, 100.0, 100.0]
    rows = [("X", "s", START + dt.timedelta(hours=i), c, 0.0, "BUY", 0.02 if i < 3 else 0.9, 0.04, 1.0) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol string, strategy string, ts timestamp_ntz, close double, volume double, signal string, stop_loss_pct double, take_profit_pct double, position_size double")
    trades = backtest.trades_of(backtest.simulate(df, backtest.Settings(max_position=1.0))).orderBy("exit_ts").collect()
    assert [t.reason for t in trades] == ["stop_loss", "take_profit", "circuit_breaker"]


def test_report_counts_all_runs(bars):
    got = backtest.report(signals.signals(bars, list(signals.STRATEGIES)[:6])).collect()
    assert len(got) == 12 and all(r.final_equity > 0 and 0 <= r.max_drawdown < 1 for r in got)


def test_kelly_and_gate(spark):
    df = spark.createDataFrame([(0.6, 2.0, 1.0, 100), (0.6, 2.0, 1.0, 10), (0.4, 1.0, 1.0, 50), (0.6, 1.0, 0.0, 50), (0.0, 0.0, 0.0, 0)], "p double, w double, l double, n long")
    got = [round(r.k, 6) for r in df.select(consensus.kelly(F.col("p"), F.col("w"), F.col("l"), F.col("n")).alias("k")).collect()]
    assert got == [0.1, 0.05, 0.0, 0.0, 0.01]
    scores = spark.createDataFrame([(1, 0.75), (2, -0.9), (3, 0.1), (4, 0.61)], "decision_id long, consensus double")
    got = {r.decision_id: (r.action, r.position_size) for r in consensus.decide(scores, F.when(F.col("decision_id") == 4, 0.001).otherwise(0.1)).collect()}
    assert got == {1: ("BUY", 0.02), 2: ("SELL", 0.02), 3: ("HOLD", 0.0), 4: ("HOLD", 0.00061)}


def test_votes_leave_out_stubs(spark):
    votes = spark.createDataFrame([(1, "ml", "BUY", 1.0, None), (1, "news", "SELL", 1.0, None), (1, "knowledge", "SELL", 1.0, "NOT_IMPLEMENTED"), (1, "other", None, 0.5, None), (2, "learner", "BUY", 1.0, None)], "decision_id long, agent string, recommendation string, confidence double, status string")
    got = {r.decision_id: (round(r.consensus, 6), r.n_votes) for r in consensus.consensus(consensus.usable(votes)).collect()}
    assert got == {1: (round((0.7 - 0.15) / 0.85, 6), 2), 2: (0.0, 1)}


def test_commission_and_slippage(spark):
    df = spark.createDataFrame([(10_000.0, 5.0), (100.0, 50.0)], "v double, q double")
    tiers = ((0, 0.002), (10, 0.001))
    got = df.select(backtest.commission(F.col("v"), F.col("q")).alias("a"), backtest.commission(F.col("v"), F.col("q"), "per_share", 0.01).alias("b"), backtest.commission(F.col("v"), F.col("q"), "tiered", 0.0, tiers).alias("c"), backtest.slippage(F.col("v"), F.lit(0.0)).alias("d"), backtest.slippage(F.col("v"), F.lit(1.0)).alias("e")).collect()
    assert [tuple(r) for r in got] == [(10.0, 1.0, 20.0, 0.0005, 0.005), (1.0, 1.0, 1.0, 0.0005, 0.005)]


def test_cleaning(spark):
    raw = spark.createDataFrame([("1735689600000", "1", "2", "0.5", "1.5", "7"), ("1735693200", "1", "2", "0.5", "x", "7"), ("2025-01-01 02:00:00", "-1", "2", "0.5", "1", "7")], "Time string, O string, H string, L string, C string, Vol string").withColumn("symbol", F.lit("X"))
    bars = cleaning.normalize_ohlcv(raw).orderBy("ts").collect()
    assert [r.ts.hour for r in bars] == [0, 1, 2] and bars[1].close is None
    table = cleaning.normalize_ohlcv(raw)
    assert cleaning.validate(table).count() == 2 and cleaning.validate(table, strict=True).count() == 1
    assert cleaning.between(table, "2025-01-01 01:00:00", "2025-01-01 02:00:00").count() == 2


@pytest.mark.parametrize("name", ["clean_bars", "clean_bars_strict"])
def test_bars_with_prices_of_zero(spark, tmp_path, name):
    """An hour that begins at 0 is kept by the queries, whose SQL looks at closes; `validate` by itself wants all prices positive."""
    rows = [(i, START + dt.timedelta(minutes=20 * i), 1, "a", v) for i, v in enumerate([0.0, 2.0, 3.0, 4.0, 5.0, 0.0, 7.0, 0.0, 9.0])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = c.execute(ORACLE_SQL[name]).fetchall()
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 2
    bars = B.hourly_bars(spark, str(tmp_path))
    assert cleaning.validate(bars).count() == 0 and cleaning.validate(bars, prices=["close"]).count() == 2


def test_splits_of_prices(spark):
    closes = [100, 101, 50.4, 51, 17.1, 17, 34, 30]
    df = spark.createDataFrame([("X", START + dt.timedelta(days=i), float(c)) for i, c in enumerate(closes)], "symbol string, ts timestamp_ntz, close double")
    assert [(r.label, r.ratio) for r in cleaning.detect_splits(df).orderBy("ts").collect()] == [("1:2", 0.499), ("1:3", 0.3353), ("2:1", 2.0)]


def test_adjusted_prices(bars):
    half = bars.withColumn("adj_close", F.when(F.col("symbol") == "AAA", F.col("close") / 2).otherwise(F.col("close")))
    got = cleaning.adjust(half).join(bars.select("symbol", "ts", F.col("close").alias("was"), F.col("volume").alias("v")), ["symbol", "ts"])
    assert got.where("symbol = 'AAA' AND (abs(close - was / 2) > 1e-6 OR volume <> bround(v * 2, 0))").count() == 0
    assert got.where("symbol = 'BBB' AND (close <> was OR volume <> v)").count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,open,high,low,close,volume\n2025-01-01,1,2,0.5,1.5,10\n2025-01-02,1,2,0.5,oops,10\n")
    (tmp_path / "b.json").write_text('{"candles": [{"t": 1, "time": 1735689600, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 3}]}')
    (tmp_path / "c.jsonl").write_text('{"timestamp": "2025-01-01 00:00:00", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 3}\nnot json\n')
    assert B.read_bars(spark, str(tmp_path / "a.csv"), "csv", "X").where("close = 1.5").count() == 1
    assert B.read_bars(spark, str(tmp_path / "b.json"), "json", "X").where("close = 1.5 AND volume = 3").count() == 1
    assert B.read_bars(spark, str(tmp_path / "c.jsonl"), "jsonl", "X").where("close = 2").count() == 1
    with pytest.raises(ValueError):
        B.read_bars(spark, "x", "xls", "X")
    scanned = files.scan(spark, str(tmp_path), contents=True)
    assert {r.ext: r.category for r in scanned.collect()} == {"csv": "data", "json": "data", "jsonl": "data"}


def test_feature_store(bars, spark, tmp_path):
    B.write_features(bars, f"{tmp_path}/f")
    assert B.read_features(spark, f"{tmp_path}/f", ["AAA"]).count() == 260


def test_file_lookup(spark):
    index = spark.createDataFrame([("BTC_USD_1H", "p1"), ("BTC_1H", "p2"), ("BTC", "p3")], "key string, path string")
    assert files.resolve(index, "btc", "1h").head().path == "p2" and files.resolve(index, "btc", "4h").head().path == "p3" and files.resolve(index, "eth", "1h").count() == 0


def test_hashes_are_of_whole_files(spark, tmp_path):
    import hashlib

    first = b"x" * (1 << 20)
    contents = {"a.bin": first + b"1", "b.bin": first + b"2", "c d%20.bin": first + b"2"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    want = {name: hashlib.sha256(content).hexdigest() for name, content in contents.items()}
    for found in (files.scan(spark, str(tmp_path), contents=True), files.scan(spark, str(tmp_path), contents=True, large=1000)):
        assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in found.collect()} == want
        assert [(r.sha256, r.copies, r.wasted) for r in files.duplicates(found).collect()] == [(want["b.bin"], 2, len(first) + 1)]
        assert files.first_of_each(found).count() == 2


def test_chunks(spark):
    text = "Chapter 1\n" + "A sentence here. " * 300 + "\n\nChapter 2\n" + "Another one there. " * 200
    got = docs.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "short")], "doc_id long, text string"), 128, 16).orderBy("chunk_idx").collect()
    assert {r.doc_id for r in got} == {1} and [r.chunk_idx for r in got] == list(range(len(got))) and {r.chapter_idx for r in got} == {0, 1}
    assert all(text[r.start_char : r.end_char].strip() == r.text for r in got)
    assert all(b.start_char < a.end_char for a, b in zip(got, got[1:]) if a.chapter_idx == b.chapter_idx)
    with pytest.raises(ValueError):
        docs.chunks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 10, 5)


def test_subtitles(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nhello there\nyou\n\n2\n00:01:00,000 --> 00:01:02,000\nbye\n\nbroken"
    cues = docs.subtitles(spark.createDataFrame([("a.srt", srt)], "path string, content string"))
    assert [(r.text, r.end) for r in cues.orderBy("seq").collect()] == [("hello there you", "00:00:02,500"), ("bye", "00:01:02,000")]
    assert docs.transcripts(cues).head().asDict() == {"path": "a.srt", "cues": 2, "duration_s": 62.0, "words": 4}
    vtt = "WEBVTT\n\nintro\n00:00:01.000 --> 00:00:02.000\nhello\n\n00:00:03.000 --> 00:00:04.000\nbye"
    assert [r.text for r in docs.subtitles(spark.createDataFrame([("a.vtt", vtt)], "path string, content string"), "vtt").orderBy("seq").collect()] == ["hello", "bye"]


def test_text_expressions(spark):
    df = spark.createDataFrame([("Technical_Analysis_(2020)_Z-Lib.pdf", 'x</think> {"sentiment": 3.5} y', "BUY the breakout, buy support")], "path string, reply string, text string")
    got = df.select(T.normalize_title(F.col("path")).alias("title"), T.reply_sentiment(F.col("reply")).alias("s"), T.occurrences(F.lower("text"), T.BULLISH_TERMS).alias("n"), T.human_size(F.lit(1536)).alias("h"), T.plain_text(F.lit("a\x00b")).alias("p")).head()
    assert tuple(got) == ("technical analysis", 1.0, 4, "1.5 KB", "ab")


def test_mmr_against_a_loop(spark):
    rng = random.Random(1)
    vectors = {i: [rng.gauss(0, 1) for _ in range(8)] for i in range(40)}
    norm = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    cos = lambda a, b: sum(x * y for x, y in zip(norm(a), norm(b)))
    near = sorted(((cos(vectors[0], v), i) for i, v in vectors.items()), reverse=True)
    chosen = []
    while len(chosen) < 6:
        chosen.append(max((i for _, i in near if i not in chosen), key=lambda i: 0.7 * cos(vectors[0], vectors[i]) - 0.3 * max((cos(vectors[i], vectors[j]) for j in chosen), default=0)))
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    found = retrieval.nearest(table.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding"), table, 40)
    got = retrieval.mmr(found.join(table, "vec_id"), k=6).orderBy("mmr_rank").collect()
    assert [r.vec_id for r in got] == chosen


def test_titles(spark):
    titles = spark.createDataFrame([("trading in the zone",), ("zone",), ("quite different",)], "title string")
    got = manifest.match_titles(titles, ["trading in the zone by douglas", "market wizards"]).collect()
    assert [(r.title, r.book) for r in got] == [("trading in the zone", "trading in the zone by douglas")]


def test_cooldown_batch_and_stream(spark, tmp_path):
    rows = [(r, s, START + dt.timedelta(seconds=t), 100) for r in ("a", "b") for s in ("X", "Y") for t in (0, 50, 99, 100, 150, 250, 260)]
    table = spark.createDataFrame(rows, "rule string, symbol string, ts timestamp, cooldown_s long").withColumn("signal", F.lit("BUY"))
    kept = {(r.rule, r.symbol, r.ts) for r in alerts.cool_down(table).collect()}
    assert kept == {(r, s, START + dt.timedelta(seconds=t)) for r in ("a", "b") for s in ("X", "Y") for t in (0, 100, 250)}
    table.write.parquet(f"{tmp_path}/in")
    streams.drain(streams.stream_cool_down(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), "10 seconds"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("rule", "symbol", "ts").collect()} == kept  # 250 s is what the watermark reaches


def test_stream_bars_equal_batch(spark, tmp_path):
    ticks = spark.createDataFrame([(i, START + dt.timedelta(minutes=7 * i), "X", float((i * 37) % 101)) for i in range(200)], "event_id long, ts timestamp, symbol string, price double")
    ticks.write.parquet(f"{tmp_path}/in")
    streams.drain(streams.stream_bars(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in"), F.col("symbol"), F.col("price"), ["ts", "event_id"]), f"{tmp_path}/out", f"{tmp_path}/state")
    batch = B.bars_from_ticks(ticks, F.col("symbol"), F.col("price"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), ["ts", "event_id"])
    want = {tuple(r) for r in batch.select("symbol", "ts", "open", "high", "low", "close", "volume").collect()}
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("symbol", "ts", "open", "high", "low", "close", "volume").collect()}
    assert got <= want and len(got) >= len(want) - 2


def test_stream_positions(spark, tmp_path):
    fills = spark.createDataFrame([("X", START + dt.timedelta(seconds=i), i, q, p) for i, (q, p) in enumerate([(10.0, 100.0), (10.0, 110.0), (-5.0, 120.0), (-20.0, 100.0)])], "symbol string, ts timestamp, seq long, quantity double, price double")
    fills.write.parquet(f"{tmp_path}/in")
    streams.drain(streams.stream_positions(spark.readStream.schema(fills.schema).parquet(f"{tmp_path}/in"), "0 seconds"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = [(r.quantity, r.cost, r.realised) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("ts").collect()]
    assert got == [(10, 100, 0), (20, 105, 0), (15, 105, 75), (-5, 100, 0)]


def test_folds():
    folds = splits.plan_folds(100, folds=3, test=20, least=30, gap=5)
    assert [(f.train_end, f.test_start, f.test_end) for f in folds] == [(30, 35, 55), (52, 57, 77), (74, 79, 99)]
    with pytest.raises(ValueError):
        splits.plan_folds(10, folds=3, test=8, least=5)


def test_folds_of_each_length(spark):
    lengths = {"a": 720, "b": 170, "c": 23, "d": 3}
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i) for s, n in lengths.items() for i in range(n)]
    out = splits.assign_own_folds(spark.createDataFrame(rows, "symbol string, ts timestamp, i int"), folds=4, gap=5)
    got = {(r.symbol, r.fold, r.part): (r.low, r.high + 1, r.n) for r in out.groupBy("symbol", "fold", "part").agg(F.min("i").alias("low"), F.max("i").alias("high"), F.count("*").alias("n")).collect()}
    want = {}
    for s in "abc":
        for f in splits.plan_folds(lengths[s], folds=4, gap=5):
            want |= {(s, f.fold, "train"): (0, f.train_end, f.train_end), (s, f.fold, "test"): (f.test_start, f.test_end, f.test_end - f.test_start)}
    assert got == want
    assert max(high for (s, _, _), (_, high, _) in got.items() if s == "a") >= 718


def test_anomalies(bars):
    got = anomaly.anomalies(bars)
    assert got.count() == 520 and got.where("confidence NOT IN (0.0, 0.3, 0.9)").count() == 0


def test_ema_starts_at_the_first_value(bars):
    first = ema(bars, {"e": ("close", 10)}).where(F.col("ts") == F.lit(START).cast("timestamp_ntz")).collect()
    assert all(r.e == r.close for r in first)


def test_long_ema_is_the_same(spark, bars, monkeypatch):
    """Symbols that span many ranges, one in the middle of a range, means of means; the choice is made by counting."""
    from tidemark.functions import windows

    spans = {"a": ("close", 20), "b": ("close", 5), "c": (("a", "b"), 9), "v": ("volume", 3)}
    want = ema(bars, spans).select("symbol", "ts", *spans)
    used = []
    monkeypatch.setattr(windows, "ema_ranges", lambda *a, f=windows.ema_ranges: (used.append(1), f(*a))[1])
    got = ema(bars, spans, longest=100)
    assert used and got.columns == [*bars.columns, *spans]
    joined = want.join(got.select("symbol", "ts", *(F.col(n).alias(f"_{n}") for n in spans)), ["symbol", "ts"])
    assert joined.count() == 520 and joined.where(" OR ".join(f"abs({n} - _{n}) > 1e-9 OR _{n} IS NULL" for n in spans)).count() == 0
    one = bars.where("symbol = 'AAA'").limit(3)
    values = lambda df: [r.a for r in df.orderBy("ts").collect()]
    assert values(windows.ema_ranges(one, {"a": ("close", 20)})) == pytest.approx(values(ema(one, {"a": ("close", 20)})))
    assert windows.ema_ranges(bars.where("false"), {"a": ("close", 20)}).count() == 0
    holes = bars.withColumn("close", F.when(F.col("close") < 100, F.col("close")))
    used.clear()
    assert ema(holes, {"a": ("close", 20)}, longest=100).count() == 520 and not used  # missing values weigh by their places: one task a symbol


def test_consensus_of_a_flat_series_has_no_votes_of_missing_values(spark):
    flat = spark.createDataFrame([("a", START + dt.timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(60)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    rows = signals.agent_consensus(flat, warm_up=50).orderBy("ts").collect()
    assert set(rows[5].votes) == {"macd"}  # no index, band or mean yet
    # without changes there is no index and no place in the band; a histogram of 0 counts as falling
    assert rows[-1].votes == {"macd": -1.0, "ma": 0.0, "volume": 0.0} and rows[-1].signal == "SELL" and rows[-1].score == pytest.approx(-1 / 3)


def test_decimals_are_rounded_from_the_binary_value(spark):
    df = spark.createDataFrame([(1280.0, 0.125, -0.125)], "n double, a double, b double")
    got = df.select(T.human_size(F.col("n")), T.fixed(F.col("a"), 2, plus=True), T.fixed(F.col("b"), 2, plus=True), T.fixed(F.col("n"), 1)).head()
    assert tuple(got) == ("1.2 KB", "+0.12", "-0.12", "1280.0")


def test_sums_of_the_last_seconds_by_one_running_sum(spark):
    """Rows of one instant, at the edges of spans, before 1970, without key or time: as the window of a range gives, without a frame that each row walks."""
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None]), dt.datetime(1970, 1, 1) + dt.timedelta(seconds=rng.choice([-1, 0, 10, 20, 30, rng.randrange(-50, 200)])), rng.choice([True, False, None])) for i in range(400)] + [(400, "a", None, False), (401, "a", None, False)]
    table = spark.createDataFrame(rows, "i long, user string, ts timestamp, ok boolean")
    w = Window.partitionBy("user").orderBy(F.unix_micros("ts"))
    want = table.select("i", F.count("*").over(w.rangeBetween(-10_000_000, 0)).alias("calls"))
    got = joins.calls_within(table, "user", 10)
    assert got.columns == [*table.columns, "calls"] and sorted(map(tuple, got.select("i", "calls").collect())) == sorted(map(tuple, want.collect()))
    want = table.where("ts IS NOT NULL").select("i", (F.coalesce(F.sum((~F.col("ok")).cast("int")).over(w.rangeBetween(-60_000_000, -1)), F.lit(0)) >= 5).alias("locked"))
    locked = portfolio.lockouts(table.where("ts IS NOT NULL"), "user", minutes=1)
    assert sorted(map(tuple, locked.select("i", "locked").collect())) == sorted(map(tuple, want.collect())) and {r.locked for r in locked.collect()} == {True, False}
    for frame in (got, locked):  # before: a frame of bounded offsets, which Spark walks anew for each row
        assert "specifiedwindowframe(RangeFrame, -" not in frame._jdf.queryExecution().optimizedPlan().toString()
