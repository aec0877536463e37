"""Window helpers over bars: every frame is per symbol, in time order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.session import ensure_checkpoint_dir

#: Rows of a symbol that one task folds, at most, and the least bytes that a plan counts for a row.
LONGEST, LEAST_ROW = 5_000_000, 24


def by_symbol() -> WindowSpec:
    """Rows of a symbol in time order."""
    return Window.partitionBy("symbol").orderBy("ts")


def trailing(n: int, skip: int = 0) -> WindowSpec:
    """The last n rows, ending `skip` rows before the current one."""
    return by_symbol().rowsBetween(-(n - 1) - skip, -skip)


def roll(agg: Callable[[Column], Column], c: Column | str, n: int) -> Column:
    """`agg` over the last n rows, null until n values that are not null are there."""
    c = F.col(c) if isinstance(c, str) else c
    w = trailing(n)
    return F.when(F.count(c).over(w) == n, agg(c).over(w))


def lag(c: Column | str, n: int = 1) -> Column:
    return F.lag(c, n).over(by_symbol())


def safe_div(a: Column, b: Column, zero: str = "null") -> Column:
    """a / b; where b is 0: null, or infinity with a's sign (null for 0 / 0) if `zero` is "inf"."""
    a, b = a.cast("double"), b.cast("double")
    if zero == "inf":
        return F.when(b == 0, F.when(a > 0, float("inf")).when(a < 0, float("-inf"))).otherwise(F.try_divide(a, b))
    return F.try_divide(a, b)


def ffill(c: Column | str) -> Column:
    return F.last(c, ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))


#: The mean of a column, or of the difference of two.
Of = str | tuple[str, str]


def ema(bars: DataFrame, spans: Mapping[str, tuple[Of, int]], longest: int = LONGEST) -> DataFrame:
    """`bars` with recursive means: name -> (column, span), alpha = 2 / (span + 1), starting at the first value.

    A column may be one made here before, or the difference of two (a pair of names). The recursion has no finite frame: symbols are
    folded in Arrow batches, all spans in one pass after one shuffle by symbol, the same that the windows use. Where the plan's size
    allows a symbol of more than `longest` rows and counting finds one, `ema_ranges` deals its rows to all tasks instead.
    """
    if _may_be_long(bars, longest):
        measured = bars.groupBy("symbol").agg(F.count("*").alias("n"), *(F.max((F.isnull(c) | F.isnan(F.col(c).cast("double"))).cast("int")).alias(f"_{c}") for c in _columns(spans)))
        found = measured.agg(F.max("n"), F.max(F.greatest(*(F.col(f"_{c}") for c in _columns(spans)), F.lit(0)))).head()
        if found[0] and found[0] > longest and not found[1]:
            return ema_ranges(bars, spans)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields] + [f"`{name}` double" for name in spans])

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable")
        for name, (column, span) in spans.items():
            values = frame[column] if isinstance(column, str) else frame[column[0]] - frame[column[1]]
            frame[name] = values.ewm(span=span, adjust=False).mean()
        return frame

    return bars.groupBy("symbol").applyInPandas(fold, schema)


def _columns(spans: Mapping[str, tuple[Of, int]]) -> list[str]:
    """The columns of the table that the means read."""
    return sorted({c for of, _ in spans.values() for c in ([of] if isinstance(of, str) else of)} - set(spans))


def _may_be_long(bars: DataFrame, longest: int) -> bool:
    """Whether the plan's estimated bytes are enough for `longest` rows of any one symbol; no job is run."""
    size = bars._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()  # a Scala BigInt, or what Py4J makes of it
    return int(str(size)) >= longest * LEAST_ROW


def _levels(spans: Mapping[str, tuple[Of, int]]) -> list[dict[str, tuple[Of, int]]]:
    """The means in groups, each of which reads the table and earlier groups only."""
    levels, left = [], dict(spans)
    while left:
        ready = {n: s for n, s in left.items() if not set([s[0]] if isinstance(s[0], str) else s[0]) & set(left)}
        if not ready:
            raise ValueError("means read each other in a circle")
        levels.append(ready)
        left = {n: s for n, s in left.items() if n not in ready}
    return levels


def ema_ranges(bars: DataFrame, spans: Mapping[str, tuple[Of, int]]) -> DataFrame:
    """`ema` for symbols too long for a task: a prefix scan over ranges of (symbol, ts), whatever the lengths.

    The recursion y = keep * y' + (1 - keep) * x is linear. Each task folds its range as if nothing came before it and notes, for the
    symbol at its beginning, how much of the unknown start is left at each row. One row a range and mean goes to the driver, which folds
    the ranges' ends in order; what a range inherits is then added to its rows. Values must not be null. The result differs
    from `ema` by rounding only.
    """
    spark, out = bars.sparkSession, bars
    ensure_checkpoint_dir(spark)
    for level in _levels(spans):
        names = list(level)
        keeps = {n: 1 - 2 / (span + 1) for n, (_, span) in level.items()}
        made = [f"_decay_{n}" for n in names]
        source = out.repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts").withColumn("_range", F.spark_partition_id())
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields] + [f"`{c}` double" for c in names + made] + ["`_place` bigint"])

        def fold(frames: Iterator[pd.DataFrame], level=level, keeps=keeps) -> Iterator[pd.DataFrame]:
            symbol, first, last, place = None, True, {}, 0
            for frame in frames:
                if frame.empty:
                    continue
                parts = []
                for _, part in frame.groupby((frame["symbol"] != frame["symbol"].shift()).cumsum(), sort=False):
                    part, begins = part.copy(), part["symbol"].iloc[0] != symbol
                    if begins:
                        first, symbol, last = symbol is None, part["symbol"].iloc[0], {}
                    for n, (of, _) in level.items():
                        x = (part[of] if isinstance(of, str) else part[of[0]] - part[of[1]]).to_numpy(dtype=float)
                        keep = keeps[n]
                        # a symbol that begins inside the range starts at its first value; at the range's beginning the start is unknown
                        before, share = last.get(n, (0.0, 1.0) if first else (x[0], 0.0))
                        part[n] = pd.Series(np.concatenate(([before], x))).ewm(alpha=1 - keep, adjust=False).mean().to_numpy()[1:]
                        part[f"_decay_{n}"] = share * keep ** np.arange(1, len(x) + 1)
                        last[n] = (part[n].iloc[-1], part[f"_decay_{n}"].iloc[-1])
                    parts.append(part)
                yield pd.concat(parts).assign(_place=np.arange(place, place + len(frame)))
                place += len(frame)

        folded = source.mapInPandas(fold, schema).checkpoint()
        value = lambda n, level=level: F.col(level[n][0]) if isinstance(level[n][0], str) else F.col(level[n][0][0]) - F.col(level[n][0][1])
        # the first and the last symbol of each range: two rows a range
        edge = F.struct("symbol", *(f"{n}" for n in names), *made, *(value(n).cast("double").alias(f"_first_{n}") for n in names))
        ends = folded.groupBy("_range").agg(F.min_by(edge, "_place").alias("head"), F.max_by(edge, "_place").alias("tail")).orderBy("_range")
        carried, symbol, end = [], None, {}
        for r in ends.collect():
            starts = {n: end[n] if r["head"]["symbol"] == symbol else r["head"][f"_first_{n}"] for n in names}
            carried.append((r["_range"], r["head"]["symbol"], *(float(starts[n]) for n in names)))
            whole = r["tail"]["symbol"] == r["head"]["symbol"]
            end = {n: r["tail"][n] + (r["tail"][f"_decay_{n}"] * starts[n] if whole else 0.0) for n in names}
            symbol = r["tail"]["symbol"]
        kinds = f"_range int, _low {dict(bars.dtypes)['symbol']}, " + ", ".join(f"`_carry_{n}` double" for n in names)
        joined = folded.join(F.broadcast(spark.createDataFrame(carried, kinds)), "_range", "left")  # a row a range
        full = {n: F.col(n) + F.when(F.col("symbol").eqNullSafe(F.col("_low")), F.col(f"_decay_{n}") * F.col(f"_carry_{n}")).otherwise(0.0) for n in names}
        out = joined.withColumns(full).select(*out.columns, *names)
    return out.select(*bars.columns, *spans)
