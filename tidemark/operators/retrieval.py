"""Vectors: cosine similarity, nearest rows, diverse selections, zero-shot labels, citations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries of a search that are sent to tasks at once; similarities that a task holds at once, about.
BLOCK, HELD = 4096, 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """The vector at length 1; null for zeros."""
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), F.sqrt(dot(a, a))))


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, similarity, rank): exact k nearest by cosine of a stated set of queries among all vectors; ties by vec_id.

    Queries go out BLOCK at a time, so what is sent to tasks is bounded; each block is a pass over the vectors. A batch of vectors
    meets a block in matrix products of about HELD similarities, of which each query keeps its k best before anything is shuffled; a
    task remembers the k best similarities of its earlier batches, and what is below them isn't sent. Vectors of zeros and nulls have no similarity and are left out; a query that several rows ask is one if their vectors are the same.
    """
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, similarity double"
    rows = vectors.where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    found = None
    for ids, block in _blocks(queries):

        def run(batches: Iterator[pa.RecordBatch], ids: pa.Array = ids, block: np.ndarray = block) -> Iterator[pa.RecordBatch]:
            best = np.full((len(block), k), -np.inf)
            for batch in batches:
                if batch.num_rows:
                    yield from _best(batch, ids, block, best)

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _units(v: np.ndarray) -> np.ndarray:
    """Rows at length 1; rows of zeros become NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return v / np.linalg.norm(v, axis=1, keepdims=True)


def _blocks(queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and unit vectors of the distinct queries, BLOCK at a time."""
    kind = to_arrow_type(queries.schema["query_id"].dataType)
    ids: list = []
    held: list = []
    for row in queries.where("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("q")).distinct().toLocalIterator():
        ids.append(row.query_id)
        held.append(row.q)
        if len(ids) == BLOCK:
            yield pa.array(ids, kind), _units(np.array(held))
            ids, held = [], []
    if ids:
        yield pa.array(ids, kind), _units(np.array(held))


def _best(batch: pa.RecordBatch, ids: pa.Array, block: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each query its k best rows of the batch, of equal ones those with the least vec_id, unless `best`, the k best similarities so far, are above them; `best` is kept up."""
    order, k = pc.sort_indices(batch.column(0)), best.shape[1]
    names, lists = batch.column(0).take(order), batch.column(1).take(order)
    v = _units(lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
    step = max(1, HELD // batch.num_rows)
    for at in range(0, len(block), step):
        # rounded, so that equal vectors are equal whatever batch they are in
        s = np.round(block[at : at + step] @ v.T, 12)
        s[np.isnan(s)] = -np.inf
        both = np.concatenate([best[at : at + step], s], axis=1)
        best[at : at + step] = np.partition(both, -k, axis=1)[:, -k:]
        query, row = np.nonzero((s >= best[at : at + step].min(axis=1, keepdims=True)) & np.isfinite(s))
        values = s[query, row]
        sort = np.lexsort((row, -values, query))
        query, row, values = query[sort], row[sort], values[sort]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + query[keep])), names.take(pa.array(row[keep])), pa.array(values[keep])], names=["query_id", "vec_id", "similarity"])


def mmr(candidates: DataFrame, k: int = 15, trade: float = 0.7) -> DataFrame:
    """(query_id, vec_id, mmr_rank): greedy choice of k among a query's candidates (query_id, vec_id, similarity, embedding).

    Each step takes the largest trade * similarity - (1 - trade) * largest similarity to what was taken. Candidates are
    a top list (fetch_k), so a query's group is bounded.
    """

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["similarity", "vec_id"], ascending=[False, True])
        v = np.stack(frame["embedding"].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        relevance, near = frame["similarity"].to_numpy(), np.zeros(len(frame))
        left, taken = np.ones(len(frame), dtype=bool), []
        while len(taken) < min(k, len(frame)):
            # rounded, so that candidates that are equal but for the order of sums are taken in order
            score = np.where(left, np.round(trade * relevance - (1 - trade) * (near if taken else 0), 9), -np.inf)
            best = int(score.argmax())
            taken.append(best)
            left[best] = False
            near = np.maximum(near, v @ v[best]) if len(taken) > 1 else v @ v[best]
        return frame.iloc[taken][["query_id", "vec_id"]].assign(mmr_rank=range(1, len(taken) + 1))

    q, v = candidates.schema["query_id"].dataType.simpleString(), candidates.schema["vec_id"].dataType.simpleString()
    return candidates.groupBy("query_id").applyInPandas(choose, f"query_id {q}, vec_id {v}, mmr_rank long")


def zero_shot(vectors: DataFrame, prompts: DataFrame, sure: float = 0.10, unsure: float = 0.05) -> DataFrame:
    """(vec_id, label, similarity, margin, status): the prompt (label, embedding) nearest to each vector, and how clear it is.

    Prompts are one row for each label.
    """
    asked = prompts.select("label", unit(F.col("embedding")).alias("q"))
    packed = asked.agg(F.sort_array(F.collect_list(F.struct("label", "q"))).alias("prompts"))
    joined = vectors.select("vec_id", unit(F.col("embedding")).alias("v")).crossJoin(F.broadcast(packed))  # one row
    ranked = F.array_sort(F.transform("prompts", lambda p: F.struct((-dot(p["q"], F.col("v"))).alias("s"), p["label"].alias("label"))))
    top = joined.select("vec_id", ranked.alias("r")).select("vec_id", F.get("r", 0)["label"].alias("label"), (-F.get("r", 0)["s"]).alias("similarity"), (F.get("r", 1)["s"] - F.get("r", 0)["s"]).alias("margin"))
    return top.withColumn("status", F.when(F.col("margin") >= sure, "trusted").when(F.col("margin") >= unsure, "needs_review").otherwise("unlabeled"))


def cluster_vectors(vectors: DataFrame, k: int = 15, dimensions: int = 50, seed: int = 42) -> DataFrame:
    """(vec_id, cluster_id, distance): PCA, then k-means; distance to the cluster's centre."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = Pipeline(stages=[PCA(k=dimensions, inputCol="v", outputCol="p"), KMeans(k=k, maxIter=300, seed=seed, featuresCol="p", predictionCol="cluster_id")]).fit(rows)
    centres = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.stages[1].clusterCenters())], "cluster_id int, c array<double>")
    placed = model.transform(rows).select("vec_id", "cluster_id", vector_to_array("p").alias("p")).join(F.broadcast(centres), "cluster_id")
    off = F.zip_with("p", "c", lambda x, y: x - y)
    return placed.select("vec_id", "cluster_id", F.round(F.sqrt(dot(off, off)), 6).alias("distance"))


def silhouette(placed: DataFrame, vectors: DataFrame) -> float:
    """Mean silhouette (squared Euclidean) of placed vectors (vec_id, cluster_id) in the space of `vectors`."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = placed.select("vec_id", F.col("cluster_id").cast("double").alias("prediction")).join(vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")), "vec_id")
    return ClusteringEvaluator().evaluate(rows)


def cluster_stats(placed: DataFrame) -> DataFrame:
    return placed.groupBy("cluster_id").agg(F.count("*").alias("size"), F.avg("distance").alias("mean_distance"), F.min("distance").alias("min_distance"))


def review_samples(placed: DataFrame, n: int) -> DataFrame:
    """The n rows nearest to each centre."""
    w = Window.partitionBy("cluster_id").orderBy("distance", "vec_id")
    return placed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def citations(found: DataFrame) -> DataFrame:
    """(query_id, citations): numbered "source, p.N" of a query's chunks, each source and page once, in order of rank."""
    first = found.groupBy("query_id", "source", "page").agg(F.min("rank").alias("rank"))
    label = F.concat(F.col("source"), F.coalesce(F.concat(F.lit(", p."), F.col("page").cast("string")), F.lit("")))
    listed = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", label.alias("label")))).alias("l"))
    return listed.select("query_id", F.transform("l", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["label"])).alias("citations"))
