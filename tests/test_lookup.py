"""Titles looked up among books, and vectors in an index, against comparing all pairs."""

import itertools
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import manifest, retrieval, vector_index
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def best_of_all(title, library, threshold):
    best = (0.0, None)
    for book in library:
        if book and 0.15 <= len(title) / len(book) <= 6.0 and (s := manifest.title_similarity(title, book)) > best[0]:
            best = (s, book)
    return (best[1], round(best[0], 9)) if best[0] >= threshold else None


@pytest.mark.parametrize("threshold", [0.6, 0.35, 0.9])
def test_titles_against_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    words = ["trading", "zone", "market", "wizards", "the", "in", "of", "naked", "forex", "größe", "7", "candlestick", "a", "art"]
    phrase = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
    library = [phrase() for _ in range(120)] + ["", "x" * 250 + " zone"] + [phrase()] * 2
    titles = [phrase() for _ in range(150)] + [b[: rng.randrange(1, len(b) + 1)] for b in library[:60]] + ["".join(rng.sample(b, len(b))) for b in library[:30]] + ["zone", "abcde", "ABCDE ZONE"]
    got = {r.title: (r.book, round(r.score, 9)) for r in manifest.match_titles(spark.createDataFrame([(t,) for t in titles * 2] + [(None,)], "title string"), library, threshold).collect()}
    want = {t: best for t in set(titles) if len(t) >= 5 and (best := best_of_all(t, library, threshold))}
    assert got == want and len(want) >= 20
    frame = spark.createDataFrame([(t,) for t in titles], "title string").distinct()
    books = spark.createDataFrame([(b, i) for i, b in enumerate(library)], "book string, position long")
    assert manifest.title_candidates(frame, books, 0.9).count() < 0.2 * frame.count() * len(library)
    assert manifest.match_titles(frame.where("false"), library).count() == 0 == manifest.match_titles(frame, []).count()


def test_books_of_images(spark):
    library = spark.createDataFrame([("12345-Trading_in-the Zone (Z-Library).pdf", 0, "psychology"), ("Market Wizards.epub", 1, "interviews"), ("market-wizards.pdf", 2, "other")], "book string, position long, topic string")
    images = ["a/PDF_Trading in the Zone_p12_img3.png", "b/EPUB_market wizards_i4.jpg", "PDF_nothing like it_p1_i1.png", "IMG_Market Wizards_p1_i1.png", "CHM_Market Wizards_p1_i1.png"]
    got = {r.path: (r.book, r.topic) for r in manifest.books_of_images(spark.createDataFrame([(i,) for i in images], "path string"), library).collect()}
    first, second = ("12345-Trading_in-the Zone (Z-Library).pdf", "psychology"), ("Market Wizards.epub", "interviews")
    assert [got[i] for i in images] == [first, second, (None, None), (None, None), second]
    rows = QUERIES["manifest_books"](spark, SF).collect()
    parts = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name").collect()
    assert len(rows) == len(parts)
    library = []
    for p in sorted(parts, key=lambda p: p.p_partkey):
        words = p.p_name.split(" ")
        if p.p_partkey % 3 == 0 and (book := " ".join(words[1:] + words[:1])) not in library:
            library.append(book)
    names = {p.p_partkey: p.p_name for p in parts}
    for r in rows:
        best = best_of_all(names[r.p_partkey].lower(), [b.lower() for b in library], 0.6)
        assert (r.book and r.book.lower().removesuffix(" (z-library).pdf"), r.score) == ((best[0], round(best[1], 6)) if best else (None, None))


def clustered(n, cells, seed=3):
    gen = np.random.default_rng(seed)
    centres = gen.normal(size=(cells, 24))
    return [(i, [float(x) for x in centres[i % cells] + 0.3 * gen.normal(size=24)]) for i in range(n)]


def test_index_finds_nine_tenths_and_reads_less(spark, tmp_path):
    rows = clustered(3000, 40)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).cache()
    index = vector_index.VectorIndex.build(vectors, f"{tmp_path}/index", k=10, recall=0.95)
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in retrieval.nearest(queries, vectors, 10).collect()}
    found = index.search(queries, 10).collect()
    assert len({(r.query_id, r.vec_id) for r in found} & exact) >= 0.9 * len(exact) == 0.9 * 1500
    read = index.visits(queries).groupBy("cell").agg(F.count("*").alias("q")).join(index.lists().groupBy("cell").agg(F.count("*").alias("n")), "cell").agg(F.sum(F.col("q") * F.col("n"))).head()[0]
    assert read < 0.3 * 150 * 3000
    # ranks and cosines are those of the vectors found, and the index opens again
    again = vector_index.VectorIndex(spark, f"{tmp_path}/index").search(queries, 10).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    assert all(abs(r.similarity - unit[r.query_id] @ unit[r.vec_id]) < 1e-9 for r in found) and {r["rank"] for r in found} == set(range(1, 11))


def test_index_of_the_embeddings(spark, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = vector_index.VectorIndex.build(vectors, f"{tmp_path}/index")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in retrieval.nearest(queries, vectors, 10).collect()}
    assert len({(r.query_id, r.vec_id) for r in index.search(queries, 10).collect()} & exact) >= 0.9 * len(exact)
    assert index.lists().count() == vectors.count()


def test_index_of_awkward_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 50)
    monkeypatch.setattr(vector_index, "SLICE", 3)
    rows = clustered(200, 4) + [(1000 + i, [1.0] * 24) for i in range(150)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] + [1.0] * 23), (2003, [None] + [1.0] * 23), (None, [1.0] * 24)]
    kind = "vec_id long, embedding array<double>"
    vectors = spark.createDataFrame(rows, kind)
    index = vector_index.VectorIndex.build(vectors, f"{tmp_path}/index", cells=4)
    assert index.lists().count() == 350 and index.lists().select("cell", "block").distinct().count() > 4
    queries = vectors.where("vec_id % 50 = 0 OR vec_id >= 2000").select(F.col("vec_id").alias("query_id"), "embedding")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in index.search(queries, 5, probes=4).collect())
    exact = retrieval.nearest(vectors.where("vec_id % 50 = 0 AND vec_id < 2000").select(F.col("vec_id").alias("query_id"), "embedding"), vectors.where("vec_id < 2000"), 5)
    assert got == sorted((r.query_id, r["rank"], r.vec_id) for r in exact.collect()) and len(got) == 35
    assert index.add(spark.createDataFrame([(1, [9.0] * 24), (5000, [-1.0] * 24), (5000, [-1.0] * 24)], kind), "more")
    assert not index.add(spark.createDataFrame([(6000, [1.0] * 24)], kind), "more")
    assert index.lists().count() == 351  # id 1 was there, 5000 came twice, the second batch of a name is left out
    near = index.search(spark.createDataFrame([(7, [-2.0] * 24)], "query_id long, embedding array<double>"), 1).head()
    assert (near.vec_id, near.similarity) == (5000, 1.0)
    assert index.search(queries.where("false"), 5).count() == 0
    with pytest.raises(ValueError):
        vector_index.VectorIndex.build(vectors.where("vec_id = 2001"), f"{tmp_path}/none")


def test_search_sends_a_query_once_to_a_part(spark, tmp_path, monkeypatch):
    """No table of a row for each query and cell is broadcast or shuffled (at 1 GB the driver had no room for it); results are those of the cells that are visited."""
    monkeypatch.setattr(vector_index, "BLOCK", 300)
    monkeypatch.setattr(vector_index, "SLICE", 500)
    rows = clustered(2000, 40) + [(2000 + i, [1.0] * 24) for i in range(800)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).cache()
    index = vector_index.VectorIndex.build(vectors.where("vec_id % 3 > 0"), f"{tmp_path}/index", cells=60)
    assert index.add(vectors.where("vec_id % 3 = 0"), "rest")
    queries = vectors.where("vec_id % 2 = 0").select(F.col("vec_id").cast("int").alias("query_id"), "embedding")
    cells, asked = len(index.centres), queries.count()
    cell_of = {r.vec_id: r.cell for r in index.lists().collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    ids, x = np.arange(2800), np.stack([unit[i] for i in range(2800)])
    of = np.array([cell_of[i] for i in range(2800)])
    for probes in (cells, 5):
        found = index.search(queries, 4, probes)
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        visited = {q: {v.cell for v in g} for q, g in itertools.groupby(index.visits(queries, probes).orderBy("query_id").collect(), lambda v: v.query_id)}
        for q in range(0, 2800, 2):
            near = np.round(x @ unit[q], 12)
            near[~np.isin(of, list(visited[q]))] = -2
            assert [i for _, i in sorted(got[q])] == [i for i in np.lexsort((ids, -near))[:4] if near[i] > -2]
        plan = found._jdf.queryExecution().executedPlan()
        assert "isFinalPlan=true" in plan.toString()
        assert 0 < max(rows_of(plan, "Exchange")) <= 25 * asked < cells * asked
        assert 0 < max(rows_of(plan, "BroadcastExchange")) <= 3 * cells  # a row for each cell and slice


def rows_of(plan, kind):
    """Rows that the exchanges of a plan made, by their metrics."""
    name, below = plan.nodeName(), plan.children()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [below.apply(i) for i in range(below.size())]
    metric = {"BroadcastExchange": "numOutputRows", "Exchange": "shuffleRecordsWritten"}[kind]
    own = [plan.metrics().apply(metric).value()] if name == kind else []
    return own + [n for p in inner for n in rows_of(p, kind)]


def test_cells_in_few_similarities_at_once(monkeypatch):
    """Cells of a batch are those of one product, in bounded memory (the order of all cells took 250 MB for a batch of full size)."""
    gen = np.random.default_rng(5)
    centres, units = gen.normal(size=(vector_index.CELLS, 8)), pd.Series(list(gen.normal(size=(10_000, 8))))
    want = np.argsort(-(np.stack(units.to_numpy()) @ centres.T), axis=1, kind="stable")
    for first in (1, 5):
        tracemalloc.start()
        got = np.stack(next(vector_index._order(centres, first).func(iter([units]))).to_numpy())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (got == want[:, :first]).mean() > 0.999 and peak < 60e6
