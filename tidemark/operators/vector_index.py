"""An index of vectors kept as Parquet: inverted lists over k-means cells, searched in the cells nearest to a query, ranked by exact cosine.

The centres are fitted on a bounded sample; every vector with a direction is in a list. How many cells a search visits is calibrated when
the index is built: exact neighbours of a bounded set of trial queries say in how many of a query's nearest cells they lie. Batches of
vectors can be added later; each is committed once, and ids that the index holds are left as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.retrieval import _best, nearest
from tidemark.sources.commits import Commits

#: Cells at most; vectors that fit the centres (of larger tables, about: a share of the hashes); trial queries that calibrate a search, at most; rows of a block, queries of a slice, about.
CELLS, SAMPLE, TRIALS, BLOCK, SLICE = 1024, 65536, 256, 16384, 8192
#: Similarities that a task holds at once, about.
HELD = 1 << 19
#: Parts that the lists are searched in, about, while a part has LEAST to BLOCK rows.
PARTS, LEAST = 64, 1024


def _directions(vectors: DataFrame) -> DataFrame:
    """vec_id, unit: vectors at length 1; those of zeros, nulls or values that aren't finite have none."""
    v = F.col("embedding").cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", v.alias("v"), length.alias("n"))
    return rows.where((F.col("n") > 0) & (F.col("n") < float("inf")) & ~F.isnan("n")).select("vec_id", F.transform("v", lambda x: x / F.col("n")).alias("unit"))


class VectorIndex:
    """Index below a folder that all executors share. Vectors: vec_id (a whole number), embedding (all of one length)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.commits = spark, Commits(spark, root)
        about = self.commits.read("model", "model", "cell int, centre array<double>, probes int").orderBy("cell").collect()  # CELLS rows at most
        self.centres, self.probes = np.array([r.centre for r in about]), about[0].probes

    @classmethod
    def build(cls, vectors: DataFrame, root: str, k: int = 10, recall: float = 0.95, cells: int | None = None) -> VectorIndex:
        """Builds and commits an index, calibrated so that the trial queries find `recall` of their k nearest. An index that is there stays."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = vectors.sparkSession
        commits = Commits(spark, root)
        if not commits.done("model"):
            rows = _directions(vectors)
            n = rows.count()
            if not n:
                raise ValueError("no vector has a direction")
            cells = cells or max(1, min(CELLS, round(math.sqrt(n))))
            part = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / n))
            points = part.select(array_to_vector("unit").alias("features"))
            centres = np.array(KMeans(k=cells, seed=42, maxIter=10, distanceMeasure="cosine", initMode="random").fit(points).clusterCenters()) if cells > 1 else np.array([rows.first().unit])
            trials = rows.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(TRIALS)
            probes = _calibrated(trials, rows, centres, k, recall)
            commits.write("vectors-0", {"lists": _listed(rows, centres)})
            model = spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], "cell int, centre array<double>, probes int")
            commits.write("model", {"model": model})
        return cls(spark, root)

    def lists(self) -> DataFrame:
        """vec_id, unit, cell, block of everything in the index."""
        return self.commits.read_all("lists", "vec_id bigint, unit array<double>, cell int, block int").drop("step")

    def add(self, vectors: DataFrame, name: str) -> bool:
        """Adds a batch under a name of its own; False if that name was added before. Ids that are there keep their vector."""
        if self.commits.done(f"vectors-{name}"):
            return False
        new = _directions(vectors).dropDuplicates(["vec_id"]).join(self.lists().select("vec_id"), "vec_id", "left_anti")
        return self.commits.write(f"vectors-{name}", {"lists": _listed(new, self.centres)})

    def visits(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """query_id, unit, cell: the cells that a search looks into, those whose centres are nearest."""
        return self._asked(queries).withColumn("cell", F.explode(self._cells(probes)))

    def _asked(self, queries: DataFrame) -> DataFrame:
        """query_id, unit: the queries that have a direction, each once, however often it is worked out: with its least vector."""
        return _directions(queries.withColumnRenamed("query_id", "vec_id")).groupBy(F.col("vec_id").cast("long").alias("query_id")).agg(F.min("unit").alias("unit"))

    def _cells(self, probes: int | None) -> Column:
        """The cells that a query's unit visits."""
        cells, probes = len(self.centres), min(probes or self.probes, len(self.centres))
        return F.sequence(F.lit(0), F.lit(cells - 1)) if probes == cells else _order(self.centres, probes)("unit")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, vec_id, similarity, rank: of the vectors in the visited cells the k nearest by cosine, ties by vec_id.

        A task holds a part of the lists, small cells together, and a slice of the queries that visit it; a query is sent to a part once,
        with the cells that it visits there. Lists that no query visits are not read beyond their cell. With `probes` as many as there are
        cells the result is exact.
        """
        sizes = {r.cell: r.n for r in self.lists().groupBy("cell").agg(F.count("*").alias("n")).collect()}  # CELLS rows at most
        first, n = _parts(sizes, len(self.centres))
        parts, slices = int((first + n).max()), max(1, -(-queries.count() // SLICE))
        piece = F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int").alias("slice")
        # both are said to be broadcast: Spark takes the size of exploded rows from before they are exploded, and would broadcast those
        places = self.spark.createDataFrame([(cell, int(first[cell]), int(n[cell])) for cell in sizes], "cell int, first int, n int")
        wanted = self.visits(queries, probes).select("cell", piece).distinct().join(F.broadcast(places), "cell")  # CELLS rows a slice at most
        part = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int")
        members = self.lists().join(F.broadcast(wanted), "cell").select(part.alias("part"), "slice", "cell", "vec_id", "unit")
        # dealt out first, as each query becomes a row for each part
        asked = self._asked(queries).repartition(parts, "query_id").withColumn("cells", self._cells(probes))
        guests = asked.mapInArrow(_sent(first, n), "part int, query_id bigint, unit array<double>, cells array<int>").select("part", piece, "query_id", "unit", "cells")

        def best(rows: pa.Table, guests: pa.Table) -> pa.Table:
            kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64())])
            if not rows.num_rows or not guests.num_rows:
                return kind.empty_table()
            rows = rows.sort_by("cell")
            cells, starts = np.unique(rows["cell"].to_numpy(), return_index=True)
            lists = rows.select(["vec_id", "unit"]).combine_chunks().to_batches()[0]
            ids, units, visited = (guests[c].combine_chunks() for c in ("query_id", "unit", "cells"))
            q = units.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            visits, guest = visited.flatten().to_numpy(), np.repeat(np.arange(len(ids)), visited.value_lengths().to_numpy())
            sort = np.argsort(visits, kind="stable")
            visits, guest = visits[sort], guest[sort]
            found, top = [], np.full((len(ids), k), -np.inf)
            for cell, start, end in zip(cells, starts, [*starts[1:], rows.num_rows]):
                g = guest[slice(*np.searchsorted(visits, [cell, cell + 1]))]
                held = top[g]
                found.extend(_best(lists.slice(start, end - start), ids.take(pa.array(g)), q[g], held))
                top[g] = held
            return pa.Table.from_batches(found, kind)

        unit = ["part", "slice"]
        found = members.groupBy(*unit).cogroup(guests.groupBy(*unit)).applyInArrow(best, "query_id bigint, vec_id bigint, similarity double")
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _parts(sizes: dict[int, int], cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell its first part and how many it has (0 if it is empty): large cells have several, small ones share one."""
    rows = min(BLOCK, max(LEAST, -(-sum(sizes.values()) // PARTS)))
    first, n, last, room = np.zeros(cells, int), np.zeros(cells, int), -1, 0
    for cell, size in sorted(sizes.items()):
        if size <= room:
            first[cell], n[cell], room = last, 1, room - size
        else:
            first[cell], n[cell] = last + 1, -(-size // rows)
            last, room = last + n[cell], max(0, rows - size)
    return first, n


def _sent(first: np.ndarray, n: np.ndarray):
    """Queries (query_id, unit, cells) to a row for each part that holds any of their cells, with those cells; about BLOCK rows at once."""
    parts = int((first + n).max())
    step = max(1, min(BLOCK // parts, HELD // len(n)))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                ids, units, visited = (batch.column(c).slice(at, step) for c in ("query_id", "unit", "cells"))
                cell, row = visited.flatten().to_numpy(), np.repeat(np.arange(len(ids)), visited.value_lengths().to_numpy())
                times = n[cell]
                nth = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
                cell, row, part = np.repeat(cell, times), np.repeat(row, times), np.repeat(first[cell], times) + nth
                sort = np.lexsort((part, row))
                cell, row, part = cell[sort], row[sort], part[sort]
                starts = np.flatnonzero(np.diff(row * parts + part, prepend=-1))
                cells = pa.ListArray.from_arrays(pa.array(np.append(starts, len(cell)), pa.int32()), pa.array(cell, pa.int32()))
                taken = pa.array(row[starts])
                yield pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), ids.take(taken), units.take(taken), cells], names=["part", "query_id", "unit", "cells"])

    return sent


def _order(centres: np.ndarray, first: int | None = None):
    """The `first` cells (all, if None) by falling similarity of their centres; a task holds about HELD similarities at once."""
    step = max(1, HELD // len(centres))

    @F.pandas_udf("array<int>")
    def order(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for units in batches:
            out: list[np.ndarray] = []
            for at in range(0, len(units), step):
                s = np.stack(units.iloc[at : at + step].to_numpy()) @ centres.T
                # copied, so that a row doesn't hold on to all of its order
                cells = s.argmax(axis=1)[:, None] if first == 1 else np.argsort(-s, axis=1, kind="stable")[:, :first]
                out.extend(cells.astype(np.int32))
            yield pd.Series(out, dtype=object)

    return order


def _listed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, unit, cell, block: cells with more than BLOCK rows have several blocks; rows of a cell lie together."""
    celled = rows.withColumn("cell", _order(centres, 1)("unit")[0])
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))  # CELLS rows at most
    blocked = celled.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int"))
    return blocked.select(F.col("vec_id").cast("long").alias("vec_id"), "unit", "cell", "block").repartition("cell", "block").sortWithinPartitions("cell", "block", "vec_id")


def _calibrated(trials: DataFrame, rows: DataFrame, centres: np.ndarray, k: int, recall: float) -> int:
    """The least number of cells in which the trial queries have `recall` of their k nearest, found by an exact search."""
    exact = nearest(trials.select(F.col("vec_id").alias("query_id"), F.col("unit").alias("embedding")), rows.select("vec_id", F.col("unit").alias("embedding")), k)
    order = _order(centres)
    asked = trials.select(F.col("vec_id").alias("query_id"), order("unit").alias("order"))
    homes = exact.join(rows, "vec_id").select("query_id", _order(centres, 1)("unit")[0].alias("cell")).join(asked, "query_id")
    depths = homes.groupBy(F.array_position("order", F.col("cell")).alias("depth")).agg(F.count("*").alias("n")).orderBy("depth").collect()  # CELLS rows at most
    total, sofar = sum(r.n for r in depths), 0
    for r in depths:
        sofar += r.n
        if sofar >= recall * total:
            return int(r.depth)
    return len(centres)
