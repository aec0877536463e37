"""Folds over a key's rows in the order of time, on streams whose rows arrive out of order.

Rows wait in list state until the watermark has passed them; a timer at the earliest of them wakes their bucket, in which each key takes
its rows up to the watermark in order. So what comes out doesn't depend on how the input was split into batches, as long as no row is
later than the watermark allows (later ones are dropped, as everywhere). State that nothing can depend on any more is cleared by a timer
too: a quiet key costs nothing. The folds are small classes, given to `in_order` for streams and to `in_batch` for tables, so
both give the same rows.

Keys share buckets, by hash, since each call of the state store costs as much as folding hundreds of rows: a batch makes a few calls for each
bucket instead of a dozen for each key.

State lives in RocksDB (`use_rocksdb`), since timers and several states per key need it.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Fold:
    """What a key does with its rows. Schemas are DDL; times are microseconds.

    rows: columns besides the time, the first of which orders rows of one instant. out: columns of what it tells.
    """

    rows: str
    out: str

    def follow(self, state: tuple | None, at: int, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        """State after all rows of one instant, and what they make; None is no state."""
        raise NotImplementedError

    def forget_at(self, state: tuple) -> int | None:
        """From when on the state is as good as none; None: never."""
        return None

    def columns(self) -> list[str]:
        return [part.split()[0] for part in self.rows.split(",")]


def _instants(rows: list[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    for at, same in groupby(sorted(rows, key=lambda r: r[:2]), key=lambda r: r[0]):
        yield at, [r[1:] for r in same]


def _columns(frame: pd.DataFrame, names: list[str]) -> list[list]:
    """Columns as lists, nulls as None."""
    return [frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in names]


def _fold(fold: Fold, state: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
    """A key's state after rows (time, the fold's columns), and what they make."""
    out: list[tuple] = []
    for at, same in _instants(rows):
        if state is not None and (end := fold.forget_at(state)) is not None and end <= at:
            state = None
        state, made = fold.follow(state, at, same)
        out += made
    return state, out


class InOrder(StatefulProcessor):
    """Keeps the rows of a bucket of keys until the watermark has passed them, then folds each key's in order.

    waiting: rows in pieces, each a pickled list of columns; states: a pickled dict of the states by key. Pickled, as converting them value by value
    takes longer than folding them.
    """

    def __init__(self, fold: Fold, keys: list[str], names: list[str]) -> None:
        self.fold, self.keys, self.names = fold, keys, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "piece binary")
        self.states = handle.getValueState("states", "held binary")

    def _wake_at(self, ms: int, passed: int) -> None:
        """One timer a bucket, at the earliest time asked for; the one that is just going off is still listed and doesn't count."""
        timers = [t for t in self.handle.listTimers() if t > passed]
        if not timers or ms < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        first = None
        for frame in rows:
            new = frame[frame["at"] // 1000 > passed]
            if len(new):
                self.waiting.appendValue((pickle.dumps(_columns(new, [*self.keys, "at", *self.fold.columns()])),))
                first = min(int(new["at"].min()), first or int(new["at"].max()))
        if first is not None:
            self._wake_at(first // 1000, passed)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, n = timerValues.getCurrentWatermarkInMs(), len(self.keys)
        due: dict[tuple, list[tuple]] = {}
        rest: list[tuple] = []
        for (piece,) in self.waiting.get():
            for r in zip(*pickle.loads(piece)):
                if r[n] // 1000 > passed:
                    rest.append(r)
                else:
                    due.setdefault(r[:n], []).append(r[n:])
        held = self.states.get()
        states: dict[tuple, tuple] = pickle.loads(held[0]) if held else {}
        out: list[tuple] = []
        for k, mine in due.items():
            state, made = _fold(self.fold, states.pop(k, None), mine)
            if state is not None:
                states[k] = state
            out += ((*k, *m) for m in made)
        ends = {k: end for k, state in states.items() if (end := self.fold.forget_at(state)) is not None}
        for k, end in ends.items():
            if end // 1000 <= passed:
                del states[k]
        if rest:
            self.waiting.put([(pickle.dumps(list(zip(*rest))),)])
        elif due:
            self.waiting.clear()
        if states:
            self.states.update((pickle.dumps(states),))
        elif held:
            self.states.clear()
        if wakes := [r[n] // 1000 for r in rest] + [end // 1000 for end in ends.values() if end // 1000 > passed]:
            self._wake_at(min(wakes), passed)
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def _prepared(rows: DataFrame, keys: list[str], fold: Fold) -> DataFrame:
    return rows.select(*keys, F.unix_micros("ts").alias("at"), "ts", *fold.columns())


def _schema(rows: DataFrame, keys: list[str], fold: Fold) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), fold.out])


def in_order(rows: DataFrame, keys: list[str], fold: Fold, late: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """What `fold` makes of a stream of rows (keys, ts, the fold's columns), sent when the watermark, `late` behind, has passed them.

    Rows with a null key, time or order column are dropped. `use_rocksdb` must have been called. A task holds the waiting rows and the states of
    one of the `buckets` at a time; their number belongs to the checkpoint, as that of shuffle partitions does.
    """
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).dropna(subset=["ts", *keys, fold.columns()[0]])
    schema = _schema(rows, keys, fold)
    names = [*keys, *(p.split()[0] for p in fold.out.split(","))]
    dealt = _prepared(rows.withWatermark("ts", late), keys, fold).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    return dealt.groupBy("_bucket").transformWithStateInPandas(InOrder(fold, keys, names), schema, "Append", "EventTime")


def in_batch(rows: DataFrame, keys: list[str], fold: Fold) -> DataFrame:
    """The same over a table, all of it."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).dropna(subset=["ts", *keys, fold.columns()[0]])
    names = [*keys, *(p.split()[0] for p in fold.out.split(","))]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, out = _fold(fold, None, list(zip(*_columns(frame, ["at", *fold.columns()]))))
        return pd.DataFrame([(*key, *r) for r in out], columns=names)

    return _prepared(rows, keys, fold).drop("ts").groupBy(*keys).applyInPandas(run, _schema(rows, keys, fold))


class Cooldown(Fold):
    """Alerts at least their cooldown after the last one kept; equal times by signal. No rule waits longer than `longest_s`."""

    rows = "signal string, cooldown_s bigint"
    out = "at bigint, signal string"

    def __init__(self, longest_s: int) -> None:
        self.longest = longest_s * 1_000_000

    def follow(self, state, at, rows):
        out = []
        for signal, wait in rows:
            if state is None or at - state[0] >= min((wait or 0) * 1_000_000, self.longest):
                state = (at,)
                out.append((at, signal))
        return state, out

    def forget_at(self, state):
        return state[0] + self.longest


class Positions(Fold):
    """Quantity, mean cost and realised profit after each fill (quantity signed)."""

    rows = "seq bigint, quantity double, price double"
    out = "at bigint, quantity double, cost double, realised double"

    def follow(self, state, at, rows):
        quantity, cost, realised = state or (0.0, 0.0, 0.0)
        out = []
        for _, q, price in rows:
            if q is None or price is None:
                continue
            if quantity * q >= 0:  # opens or adds: the mean price moves
                cost = (cost * abs(quantity) + price * abs(q)) / abs(quantity + q) if quantity + q else 0.0
            else:
                realised += min(abs(q), abs(quantity)) * (price - cost) * (1 if quantity > 0 else -1)
                cost = cost if abs(q) < abs(quantity) else price if abs(q) > abs(quantity) else 0.0
            quantity += q
            out.append((at, quantity, cost, realised))
        return (quantity, cost, realised), out


class Stops(Fold):
    """Positions by fills, closed by the first tick that reaches a stop or profit.

    rows: seq (orders rows of one instant), kind ("fill" or "tick"), price, quantity (signed, of a fill), stop_loss, take_profit (shares
    of the entry price, of a fill). A fill of the position's side moves its mean price, one of the other side closes it, wholly or in
    part, and what is left over opens the other side. Each close is a row: event fill, stop_loss or take_profit. The stop and
    profit are those of the last fill that opened or added. Ticks without a price and fills of nothing change nothing.
    """

    rows = "seq bigint, kind string, price double, quantity double, stop_loss double, take_profit double"
    out = "at bigint, event string, side string, entry_price double, price double, quantity double, pnl double"

    def follow(self, state, at, rows):
        out = []

        def close(event: str, price: float, quantity: float) -> None:
            sign = 1.0 if state[0] > 0 else -1.0
            out.append((at, event, "LONG" if sign > 0 else "SHORT", state[1], price, quantity, sign * (price - state[1]) * quantity))

        for _, kind, price, quantity, stop, take in rows:
            if price is None:
                continue
            if kind == "fill":
                if not quantity:
                    continue
                held = state[0] if state else 0.0
                if held * quantity < 0:
                    closed = min(abs(held), abs(quantity))
                    close("fill", price, closed)
                    left = held + quantity
                    if held * left > 0:
                        state = (left, *state[1:])
                        continue
                    state, held, quantity = None, 0.0, left
                    if not quantity:
                        continue
                entry = (state[1] * abs(held) + price * abs(quantity)) / abs(held + quantity) if state else price
                state = (held + quantity, entry, stop, take)
            elif state and state[1]:
                move = (1.0 if state[0] > 0 else -1.0) * (price - state[1]) / state[1]
                event = "stop_loss" if state[2] is not None and move <= -state[2] else "take_profit" if state[3] is not None and move >= state[3] else None
                if event:
                    close(event, price, abs(state[0]))
                    state = None
        return state, out


class Calls(Fold):
    """For each row the number of rows of its key in the last `seconds`, itself and others of its instant included."""

    rows = "call_id bigint"
    out = "call_id bigint, calls bigint"

    def __init__(self, seconds: int) -> None:
        self.span = seconds * 1_000_000

    def follow(self, state, at, rows):
        held = state[0] if state else []
        times = held if isinstance(held, list) else list(held)
        low = bisect_left(times, at - self.span)  # times come in order
        if low > len(times) // 2:  # what is too old goes once it is the larger part, so that a row is moved about once
            times, low = times[low:], 0
        times.extend([at] * len(rows))
        return (times,), [(i, len(times) - low) for (i,) in rows]

    def forget_at(self, state):
        return state[0][-1] + self.span + 1
