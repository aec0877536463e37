"""Folds on streams: any order and any split of the rows give what the table gives; scans chained through commits survive a stop."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts, desk, joins
from tidemark.plans import streaming as plans
from tidemark.sources.commits import Commits
from tidemark.streaming import ordered, paper, streams

START = dt.datetime(2025, 3, 1)


def as_stream(spark, rows, schema, root, files, late_s, seed):
    """A stream of `files` files in which a row comes up to `late_s` seconds out of order."""
    rng = random.Random(seed)
    keyed = sorted(((r[1] + dt.timedelta(seconds=rng.uniform(0, late_s)), rng.random(), r) for r in rows), key=lambda x: x[:2])
    step = -(-len(keyed) // files)
    for k in range(files):
        part = [r for *_, r in keyed[k * step : (k + 1) * step]]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def drained(spark, stream, root):
    streams.drain(stream, f"{root}/out", f"{root}/state")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def passed(rows, late_s):
    """What the last watermark has passed, to the millisecond."""
    return max(r[1] for r in rows) - dt.timedelta(seconds=late_s)


@pytest.mark.parametrize("files", [1, 4])
def test_cooldowns_of_any_split(spark, tmp_path, files):
    rng = random.Random(files)
    schema = "symbol string, ts timestamp, rule string, signal string, cooldown_s long"
    rows = [(s, START + dt.timedelta(seconds=rng.randrange(0, 9000)), r, rng.choice(["BUY", "SELL"]), w) for s in ("X", "Y", "Z") for r, w in (("a", 300), ("b", 900)) for _ in range(60)]
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
    table = spark.createDataFrame(rows, schema)
    end = passed(rows, 600)
    want = {(r.rule, r.symbol, r.ts, r.signal) for r in alerts.cool_down(table).collect() if r.ts <= end}
    out = drained(spark, streams.stream_cool_down(as_stream(spark, rows, schema, tmp_path, files, 600, 3), "600 seconds", 900), tmp_path)
    assert {(r.rule, r.symbol, r.ts, r.signal) for r in out.collect()} == want and len(want) > 50


def test_late_rows_are_dropped_and_rows_with_nulls_too(spark, tmp_path):
    schema = "symbol string, ts timestamp, rule string, signal string, cooldown_s long"
    at = lambda m: START + dt.timedelta(minutes=m)
    files = [[("X", at(0), "a", "BUY", 60), ("X", at(60), "a", "BUY", 60)], [("X", at(5), "a", "SELL", 60), ("X", at(55), "a", "SELL", 60), (None, at(56), "a", "BUY", 60), ("X", None, "a", "BUY", 60), ("X", at(57), "a", None, 60)], [("X", at(90), "a", "BUY", None)]]
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = drained(spark, streams.stream_cool_down(source, "10 minutes"), tmp_path)
    # the first file moves the watermark to minute 50, so minute 5 comes too late and minute 55 does not
    assert sorted((r.ts - START).seconds // 60 for r in out.collect()) == [0, 55, 60]


def by_hand(rows):
    """Closes of positions, row by row in order of time and seq; rows: symbol, ts, seq, kind, price, quantity, stop, take."""
    out, held = [], {}
    for s, ts, _, kind, price, q, stop, take in sorted(rows, key=lambda r: (r[1], r[2])):
        side, entry, n, stop_at, take_at = held.get(s, (0, 0.0, 0.0, 0.0, 0.0))
        if kind == "fill":
            mine = 1 if q > 0 else -1
            if side and mine != side:
                closed = min(n, abs(q))
                out.append((s, ts, "fill", "LONG" if side > 0 else "SHORT", entry, price, closed, side * (price - entry) * closed))
                n, rest = n - closed, abs(q) - closed
                held[s] = (side, entry, n, stop_at, take_at) if n else (mine, price, rest, stop, take) if rest else (0, 0.0, 0.0, 0.0, 0.0)
            else:
                held[s] = (mine, (entry * n + price * abs(q)) / (n + abs(q)), n + abs(q), stop, take)
        elif side:
            move = side * (price - entry) / entry
            event = "stop_loss" if move <= -stop_at else "take_profit" if move >= take_at else None
            if event:
                out.append((s, ts, event, "LONG" if side > 0 else "SHORT", entry, price, n, side * (price - entry) * n))
                held[s] = (0, 0.0, 0.0, 0.0, 0.0)
    return out


def test_stops_of_any_split(spark, tmp_path):
    rng = random.Random(9)
    rows, seq = [], 0
    for s in ("X", "Y", "Z"):
        price = 100.0
        for i in range(150):
            price *= 1 + rng.gauss(0, 0.02)
            ts = START + dt.timedelta(seconds=10 * i + rng.choice([0, 0, 3]))
            if rng.random() < 0.15:
                rows.append((s, ts, 2 * seq, "fill", price, float(rng.choice([-2, -1, 1, 2, 3])), 0.03, 0.05))
            rows.append((s, ts, 2 * seq + 1, "tick", price, None, None, None))
            seq += 1
    schema = "symbol string, ts timestamp, seq long, kind string, price double, quantity double, stop_loss double, take_profit double"
    rounded = lambda r: (*r[:4], *(round(x, 6) for x in r[4:]))
    want = sorted(map(rounded, by_hand(rows)))
    kinds = {r[2] for r in want}
    assert kinds == {"fill", "stop_loss", "take_profit"} and len(want) > 40
    batch = ordered.in_batch(spark.createDataFrame(rows, schema), ["symbol"], ordered.Stops()).withColumn("ts", F.timestamp_micros("at")).select("symbol", "ts", "event", "side", "entry_price", "price", "quantity", "pnl")
    assert sorted(map(rounded, batch.collect())) == want
    source = as_stream(spark, rows, schema, tmp_path, 4, 120, 1)
    plain = source.withColumn("seq", F.floor(F.col("seq") / 2))
    out = drained(spark, streams.stream_stops(plain.where("kind = 'fill'"), plain.where("kind = 'tick'"), "120 seconds"), tmp_path)
    end = passed(rows, 120)
    assert sorted(map(rounded, out.collect())) == [r for r in want if r[1] <= end]


def test_stops_equal_a_paper_scan(spark):
    """One tick for each held position closes what a scan at the same prices closes, with the same profit."""
    rng = random.Random(4)
    held = [("a", f"S{i}", rng.choice(["LONG", "SHORT"]), 100.0, float(rng.randrange(1, 9)), 0.02, 0.04) for i in range(60)]
    prices = {s: 100 * (1 + rng.uniform(-0.06, 0.06)) for _, s, *_ in held}
    none = spark.createDataFrame([], "account string, symbol string, action string, approved boolean, position_size double")
    *_, trades = desk.paper_scan(spark.createDataFrame([("a", 1000.0, 1000.0)], "account string, cash double, peak double"), spark.createDataFrame(held, desk.POSITIONS), spark.createDataFrame(list(prices.items()), "symbol string, price double"), none)
    want = sorted((r.symbol, r.event, r.side, round(r.pnl, 6)) for r in trades.collect())
    fills = spark.createDataFrame([(s, START, 0, p, q if side == "LONG" else -q, stop, take) for _, s, side, p, q, stop, take in held], "symbol string, ts timestamp, seq long, price double, quantity double, stop_loss double, take_profit double")
    ticks = spark.createDataFrame([(s, START + dt.timedelta(seconds=5), 0, p) for s, p in prices.items()], "symbol string, ts timestamp, seq long, price double")
    got = ordered.in_batch(streams.fills_and_ticks(fills, ticks), ["symbol"], ordered.Stops()).collect()
    assert sorted((r.symbol, r.event, r.side, round(r.pnl, 6)) for r in got) == want and len(want) > 20


def test_calls_and_sessions_of_any_split(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"u{rng.randrange(6)}", START + dt.timedelta(seconds=rng.randrange(0, 6000)), i, float(i)) for i in range(400)]
    schema = "user string, ts timestamp, call_id long, value double"
    table, end = spark.createDataFrame(rows, schema), passed(rows, 300)
    want = {(r.call_id, r.calls) for r in joins.calls_within(table, "user", 60).collect() if r.ts <= end}
    (tmp_path / "c").mkdir(), (tmp_path / "s").mkdir()
    out = drained(spark, streams.stream_calls(as_stream(spark, rows, schema, tmp_path / "c", 3, 300, 5), "user", "call_id", 60, "300 seconds"), tmp_path / "c")
    assert {tuple(r) for r in out.collect()} == want and len(want) > 300
    sessions = {(r.user, r.start, r.events, r.value) for r in joins.sessions(table, "user", "40 seconds").collect()}
    out = drained(spark, streams.stream_sessions(as_stream(spark, rows, schema, tmp_path / "s", 3, 300, 6), "user", "40 seconds", "300 seconds"), tmp_path / "s")
    got = {tuple(r) for r in out.collect()}
    last = {s: max(r[1] for r in rows if r[0] == s[0] and r[1] >= s[1] and sum(1 for x in rows if x[0] == s[0] and s[1] <= x[1] <= r[1]) <= s[2]) for s in sessions}
    assert got == {s for s in sessions if last[s] + dt.timedelta(seconds=40) <= end} and len(got) > 50


def test_quiet_keys_have_no_state():
    fold = ordered.Cooldown(100)
    state, out = fold.follow(None, 5_000_000, [("BUY", 60), ("SELL", 0)])
    assert out == [(5_000_000, "BUY"), (5_000_000, "SELL")] and fold.forget_at(state) == 105_000_000
    calls = ordered.Calls(60)
    state, out = calls.follow(([0, 10_000_000],), 65_000_000, [(1,), (2,)])
    assert out == [(1, 3), (2, 3)] and calls.forget_at(state) == 125_000_001
    assert ordered.Stops().follow(None, 0, [(0, "fill", 10.0, 0.0, None, None), (1, "tick", None, None, None, None), (2, "fill", 10.0, 1.0, None, None), (3, "tick", 1.0, None, None, None)]) == ((1.0, 10.0, None, None), [])


def test_calls_walk_no_window_for_each_row():
    """200,000 calls in one window (each walked all before it: more than 10^10 steps), and a state that keeps no more than about two windows."""
    calls, state, began = ordered.Calls(60), None, time.process_time()
    for i in range(200_000):
        state, out = calls.follow(state, i * 100, [(i,)])
    assert out == [(199_999, 200_000)] and time.process_time() - began < 20
    for i in range(1000):
        state, out = calls.follow(state, 100_000_000 + i * 10_000_000, [(i,)])
        assert out == [(i, min(i + 1, 7))] and len(state[0]) <= 16


def test_keys_share_state_entries(spark, tmp_path):
    """3000 keys come in each of two batches; what the state store is asked for grows with the buckets, not with the keys."""
    rng = random.Random(8)
    rows = [(f"s{k}", START + dt.timedelta(seconds=rng.randrange(0, 5000)), 3 * k + i, rng.choice([-1.0, 1.0, 2.0]), float(rng.randrange(1, 9))) for k in range(3000) for i in range(3)]
    schema = "symbol string, ts timestamp, seq long, quantity double, price double"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ordered.use_rocksdb(spark)
    try:
        stream = streams.stream_positions(as_stream(spark, rows, schema, tmp_path, 2, 200, 4), "200 seconds")
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress]
    assert len(held) == 3 and 0 < max(held) <= 2 * 1024  # of each bucket the list of what waits and the states
    end = passed(rows, 200)
    table = ordered.in_batch(spark.createDataFrame(rows, schema), ["symbol"], ordered.Positions())
    want = sorted(tuple(r) for r in table.select("symbol", F.timestamp_micros("at").alias("ts"), "quantity", "cost", "realised").collect() if r.ts <= end)
    assert sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect())) == want and len(want) > 8000


@pytest.mark.parametrize("even", [True, False])
def test_a_batch_of_a_shuffled_stream_is_a_part_of_many_files(spark, tmp_path, monkeypatch, even):
    """Large parts are several files, yet a batch takes one part whole, so no row is too late; uneven parts are one file each."""
    monkeypatch.setattr(plans, "FILE_ROWS", 200)
    days = [i % 60 for i in range(3000)] if even else [0] * 2990 + [30] * 5 + [60] * 5
    rows = [(i, START + dt.timedelta(days=d, seconds=i)) for i, d in enumerate(days)]
    source = plans.shuffled_stream(spark.createDataFrame(rows, "id long, ts timestamp"), str(tmp_path))
    batches = []
    source.writeStream.foreachBatch(lambda b, _: batches.append([(r.id, r.ts) for r in b.collect()])).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    files = len(spark.read.parquet(f"{tmp_path}/in").inputFiles())
    assert len(batches) == plans.PARTS and (files >= 4 * plans.PARTS if even else files == plans.PARTS)
    assert sorted(r for b in batches for r in b) == rows
    for k in range(1, len(batches)):
        seen = [ts for b in batches[:k] for _, ts in b]
        assert all(ts > max(seen) - dt.timedelta(hours=plans.DISORDER_H) for _, ts in batches[k])


def test_scans_survive_a_stop_before_and_after_their_commit(spark, tmp_path, monkeypatch):
    rows = []
    for k in (1, 2, 3):
        for s, p in (("S1", 10.0 + k), ("S2", 20.0 - 3 * k)):
            rows.append((k, s, p, None, None, None, None, None, None))
            rows += [(k, s, None, a, "BUY" if s == "S1" else "SELL", True, 0.1, 0.05, 0.05) for a in ("a", "b")]
    table = spark.createDataFrame(rows, paper.SCANS)
    accounts = spark.createDataFrame([("a", 1000.0, 1000.0), ("b", 500.0, 500.0)], "account string, cash double, peak double")
    batch = lambda k: table.where(F.col("scan") == k)
    tell = lambda d: (sorted(map(str, d.trades().drop("step").collect())), sorted(map(str, d.state(2)[0].collect())), sorted(map(str, d.state(2)[1].collect())))
    whole = paper.PaperDesk(accounts, f"{tmp_path}/whole")
    for k in (1, 2, 3):
        whole.apply(batch(k), k - 1)
    broken = paper.PaperDesk(accounts, f"{tmp_path}/broken")
    broken.apply(batch(1), 0)
    broken.apply(batch(1), 0)  # comes again after its commit
    rename = Commits._path
    with monkeypatch.context() as m:  # tables written, then a stop before the rename
        m.setattr(Commits, "_path", lambda self, name: (_ for _ in ()).throw(RuntimeError("stop")) if name.startswith("_attempt") else rename(self, name))
        with pytest.raises(RuntimeError):
            broken.apply(batch(2), 1)
    assert not broken.commits.done(1)
    broken.apply(batch(2), 1)
    broken.apply(batch(3), 2)
    assert tell(broken) == tell(whole) and len(tell(whole)[0]) >= 8
    # the same scans one after the other by hand
    state, positions = accounts, spark.createDataFrame([], desk.POSITIONS)
    for k in (1, 2, 3):
        own = batch(k)
        state, positions, _ = desk.paper_scan(state.select("account", "cash", "peak"), positions, own.where("account IS NULL").select("symbol", "price"), own.where("account IS NOT NULL").drop("price"))
    assert sorted(map(str, positions.collect())) == tell(whole)[2]
    assert paper.PaperDesk(accounts, f"{tmp_path}/none").trades().count() == 0
    both = paper.PaperDesk(accounts, f"{tmp_path}/both")
    both.apply(table, 0)  # several scans of one batch run in their order
    assert sorted(map(str, both.trades().drop("step").collect())) == tell(whole)[0]
