"""Hard negatives by exact search in k-means inverted lists.

Vectors are dealt into lists by their nearest centre; each list keeps its centre's radius r, the largest distance of a member. By
Cauchy-Schwarz a member's inner product with an anchor a lies within <a, centre> +- |a| r. An anchor visits lists by falling
upper bound in rounds, keeps its best k so far, leaves out lists whose range misses its window of scores and stops where the bound
falls strictly below the k-th score (equal scores may still win by id). So the result is that of scoring every row.

Centres are fitted on a bounded sample and only decide how much is visited. Lists are split into blocks of at most about BLOCK
rows and anchors into slices of about SLICE, so a list that holds a third of all rows is spread over tasks, and a task holds one
block and one slice, however many rows there are. Anchors never meet on the driver; it gets the centres, radii and counts
of at most CELLS lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import release, stored

#: Lists at most; rows of the sample that fits the centres (of larger tables, about: a share of the hashes); rows of a block and anchors of a slice, about.
CELLS, SAMPLE, BLOCK, SLICE = 256, 32768, 16384, 16384
#: Lists that an anchor has visited after each round.
ROUNDS = (8, 64, CELLS)
#: An inner product below this is exact in doubles, in any order of summing.
EXACT = float(1 << 53)
#: Sorts null ids last; taken for null in results.
NO_ID = (1 << 63) - 1
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
CANDIDATES = "anchor bigint, anchor_id bigint, goal int, score bigint, id bigint"


def integer_vectors(rows: DataFrame, anchors: Column, id_col: str, vec_col: str, label: Column, scale: float) -> DataFrame:
    """id, label, is_anchor, vec of floor(scale * x) as doubles; without rows of a null label or vector or any component null or not finite."""
    sound = F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), label.alias("label"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"), F.col(vec_col).cast("array<double>").alias("_vec"))
    whole = F.transform("_vec", lambda x: F.floor(x * scale).cast("double"))
    return named.where(F.col("label").isNotNull() & F.col("_vec").isNotNull() & sound).select("id", "label", "is_anchor", whole.alias("vec"))


@dataclass
class Lists:
    """rows: row, id, label, vec, cell, block. Of each cell: its centre, radius and number of blocks."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    blocks: np.ndarray


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Arrow lists of `dims` numbers as rows."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def inverted_lists(rows: DataFrame, dims: int, n: int) -> Lists:
    """Lists of all `n` rows (row, id, label, vec of `dims` integers): sqrt(n) / 2 of them, CELLS at most.

    The centres are fitted on all rows, or on about SAMPLE of them, chosen by hash.
    """
    cells = max(1, min(CELLS, round(math.sqrt(n) / 2)))
    part = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("id", "row"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / n))
    points = part.select(array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    if part.limit(1).count() == 0:
        centres = np.zeros((1, dims))
    elif dims == 0 or cells == 1:
        centres = np.zeros((1, dims))
    else:
        centres = np.array(KMeans(k=cells, seed=7, maxIter=8, initMode="random").fit(points).clusterCenters())
    half = (centres * centres).sum(1) / 2

    @F.pandas_udf("cell int, distance double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            x = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), dims)
            cell = (x @ centres.T - half).argmax(1)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "distance": np.sqrt(((x - centres[cell]) ** 2).sum(1))})

    dealt = stored(rows.withColumn("_at", nearest("vec")).select(*rows.columns, "_at.cell", "_at.distance"), "dealt")
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()  # CELLS rows at most
    radii, blocks = np.full(len(centres), -1.0), np.zeros(len(centres), dtype=np.int64)
    for r in sizes:
        radii[r.cell], blocks[r.cell] = r.radius, -(-r.n // BLOCK)
    counts = F.create_map(*(F.lit(x) for k, b in enumerate(blocks.tolist()) for x in (k, b)))
    block = F.pmod(F.xxhash64("row"), F.element_at(counts, F.col("cell"))).cast("int")
    return Lists(dealt.select(*rows.columns, "cell", block.alias("block")), centres, radii, blocks)


def _visits(anchors: DataFrame, lists: Lists, dims: int, first: int, last: int) -> DataFrame:
    """anchor, anchor_id, label, vec, slice, goals, cell, block: what anchors still have to visit among their lists of ranks first to last.

    goals: array of (goal, low, high, least): the window of scores and the k-th score so far, null before there are k.
    """
    centres, radii = lists.centres, lists.radii
    blocks = lists.blocks

    @F.pandas_udf("array<struct<cell:int,block:int>>")
    def wanted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vectors, goals in batches:
            a = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), dims)
            middle, norm = a @ centres.T, np.sqrt((a * a).sum(1))[:, None]
            slack = norm * radii * (1 + 1e-9) + 1e-6 * (1 + np.abs(middle))  # doubles are rounded, scores are whole numbers
            upper, lower = np.floor(middle + slack), np.ceil(middle - slack)
            upper[:, radii < 0] = -np.inf  # lists without members
            order = np.argsort(-upper, axis=1, kind="stable")[:, first:last]
            rows = []
            for i, own in enumerate(goals):
                cells = order[i]
                take = np.zeros(len(cells), dtype=bool)
                for g in own:
                    low = -np.inf if g["low"] is None else g["low"]
                    least = low if g["least"] is None else max(low, g["least"])
                    take |= (upper[i, cells] >= least) & (lower[i, cells] <= (np.inf if g["high"] is None else g["high"])) & (radii[cells] >= 0)
                rows.append([{"cell": int(c), "block": b} for c in cells[take] for b in range(blocks[c])])
            yield pd.Series(rows)

    return anchors.withColumn("_to", F.explode(wanted("vec", "goals"))).select("anchor", "anchor_id", "label", "vec", "slice", "goals", "_to.cell", "_to.block")


def _scored(lists: Lists, visits: DataFrame, dims: int, keep: int, same: bool) -> DataFrame:
    """CANDIDATES: of each block, the best `keep` rows for each goal of each anchor that visits it; ties at the end by id."""

    def score(members: pa.Table, guests: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if members.num_rows and guests.num_rows:
            x, ids, row = _matrix(members["vec"], dims), members["id"].to_numpy(), members["row"].to_numpy()
            codes = pd.factorize(np.concatenate([members["label"].to_numpy(), guests["label"].to_numpy()]))[0]
            labels, own = codes[: len(x)], codes[len(x) :]
            a, anchors, names, goals = _matrix(guests["vec"], dims), guests["anchor"].to_pylist(), guests["anchor_id"].to_pylist(), guests["goals"].to_pylist()
            step = max(1, (1 << 22) // len(x))  # scores of so many anchors are held at once
            for at in range(0, len(a), step):
                for i, scores in enumerate(a[at : at + step] @ x.T, at):
                    fits = (labels == own[i]) & (row != anchors[i]) if same else labels != own[i]
                    for g in goals[i]:
                        low = max([v for v in (g["low"], g["least"]) if v is not None], default=-np.inf)
                        found = np.flatnonzero(fits & (scores >= low) & (scores <= (np.inf if g["high"] is None else g["high"])))
                        if len(found) > keep:
                            s = scores[found]
                            found = found[s >= np.partition(s, len(s) - keep)[len(s) - keep]]
                        for j in found[np.lexsort((ids[found], -scores[found]))[:keep]].tolist():
                            out.append((anchors[i], names[i], g["goal"], int(scores[j]), int(ids[j])))
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["anchor", "anchor_id", "goal", "score", "id"])

    unit = ["cell", "block", "slice"]
    asked = visits.select(*(F.col(c).alias(c) for c in unit)).distinct()  # blocks that nobody visits go no further
    members = lists.rows.join(asked, ["cell", "block"]).select(*unit, "row", "id", "label", "vec")
    return members.groupBy(*unit).cogroup(visits.groupBy(*unit)).applyInArrow(score, CANDIDATES)


def _search(anchors: DataFrame, lists: Lists, dims: int, keep: int, same: bool) -> DataFrame:
    """CANDIDATES with rank: the first `keep` rows for each goal of each anchor (anchor, anchor_id, label, vec, slice, goals)."""
    order = Window.partitionBy("anchor", "goal").orderBy(F.desc("score"), F.asc("id"))
    best, first = None, 0
    for last in ROUNDS:
        if first >= len(lists.centres):
            break
        state = anchors
        if best is not None:
            least = best.where(F.col("rank") == keep).select("anchor", "goal", F.col("score").alias("least"))
            least = least.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("goal", "least"))).alias("_least"))  # an entry a goal
            goals = F.transform("goals", lambda g: g.withField("least", F.try_element_at("_least", g["goal"])))
            state = anchors.join(least, "anchor", "left").withColumn("goals", goals).select(anchors.columns)
        visits = stored(_visits(state, lists, dims, first, last), "visits")
        found = _scored(lists, visits, dims, keep, same)
        found = found if best is None else found.unionByName(best.drop("rank"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
        before, best = best, stored(ranked, "best")
        for used in (visits, before):
            if used is not None:
                release(used)
        first = last
    return best


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (RESULT).

    A score is the integer inner product of floor(scale * x); higher ones come first, ties by smaller id, null ids last. For each row
    with `anchors` true and each of its first `positives` other rows of the same label: the first `negatives` rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score. Fewer rows give what there is; a positive
    without any such negative gives no row.

    Rows with a null label or vector, or with a component that is null or not finite, take no part. A shorter vector counts as
    followed by zeros. Rows with repeated ids stay rows of their own (an anchor's copy may be its positive). An empty table gives no rows.
    Vectors whose squared length reaches 2^53 can't be scored exactly and are an error. Other columns are not read.
    """
    spark = rows.sparkSession
    picked = integer_vectors(rows, anchors, id_col, vec_col, F.col("label") if label is None else label, scale)
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    about = picked.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims"), F.max(square).alias("square")).head()
    if not about.n:
        return spark.createDataFrame([], RESULT)
    if about.square >= EXACT:
        raise ValueError(f"vectors of squared length {about.square:.3g} can't be scored exactly; take a smaller scale")
    dims = about.dims
    padded = F.transform(F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("vec"))), lambda x: x.cast("int"))
    table = stored(picked.select(F.monotonically_increasing_id().alias("row"), "id", "label", "is_anchor", padded.alias("vec")), "vectors")
    lists = inverted_lists(table.select("row", "id", "label", "vec"), dims, about.n)

    chosen = table.where("is_anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "label", "vec")
    slices = max(1, -(-chosen.count() // SLICE))
    chosen = chosen.withColumn("slice", F.pmod(F.xxhash64("anchor"), F.lit(slices)).cast("int"))
    anything = F.expr("array(named_struct('goal', 0, 'low', CAST(NULL AS BIGINT), 'high', CAST(NULL AS BIGINT), 'least', CAST(NULL AS BIGINT)))")
    near = _search(chosen.withColumn("goals", anything), lists, dims, positives, True)
    near = near.select("anchor", F.col("rank").alias("goal"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    # low * p <= 100 * s <= high * p in whole numbers
    whole = lambda x: f"({x} - pmod({x}, 100)) div 100"
    bounds = near.select("anchor", "goal", F.expr(f"-{whole(f'(-positive_score * {low})')}").alias("low"), F.expr(whole(f"(positive_score * {high})")).alias("high"), F.lit(None).cast("long").alias("least"))
    windows = bounds.where("low <= high").groupBy("anchor").agg(F.collect_list(F.struct("goal", "low", "high", "least")).alias("goals"))  # `positives` entries at most
    mined = _search(chosen.join(windows, "anchor"), lists, dims, negatives, False)
    out = mined.join(near, ["anchor", "goal"])
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.withColumn("negative_id", F.col("id")).select(known("anchor_id"), known("positive_id"), "rank", known("negative_id"), "positive_score", F.col("score").alias("negative_score"))
