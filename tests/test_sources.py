"""Files read without losing what is broken, catalogs and stores that grow, folds of features without values."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import knowledge, learn, portfolio
from tidemark.operators import text as docs
from tidemark.sources import bars as B
from tidemark.sources import files, tolerant
from tidemark.sources.commits import Commits

BAR = {"Date": "2025-01-01 00:00:00", "Open": 1, "High": 2.5, "Low": 1, "Close": 2, "Volume": 3}
SHAPES = {
    "array.json": (json.dumps([BAR, BAR | {"Date": "2025-01-01 01:00:00"}, 7, None]), 2, 2),
    "nested.json": (json.dumps({"meta": {}, "candles": [BAR], "result": [BAR, BAR]}), 1, 0),  # candles comes before result
    "not_nested.json": (json.dumps({"data": {"x": 1}, "Close": 5}), 1, 0),
    "flat.json": (json.dumps(BAR), 1, 0),
    "lines.jsonl": (json.dumps(BAR) + "\n\n  \n" + json.dumps([BAR, BAR]) + '\n{"Close": \nplain words\n' + json.dumps(BAR), 4, 2),
    "number.json": ("12", 0, 1),
    "empty.json": ("", 0, 0),
    "broken.json": ('{"data": [', 0, 1),
}


@pytest.mark.parametrize("large", [1 << 20, 0])
def test_json_of_every_shape(spark, tmp_path, large):
    for name, (text, _, _) in SHAPES.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "bytes.jsonl").write_bytes(b'\xef\xbb\xbf{"close": "\xff"}\n')
    read = tolerant.read_json(spark, str(tmp_path), large).cache()
    got = {r.name: (r.good, r.bad) for r in read.groupBy(F.substring_index("path", "/", -1).alias("name")).agg(F.count("record").alias("good"), F.count("reject").alias("bad")).collect()}
    want = {name: (good, bad) for name, (_, good, bad) in SHAPES.items() if good or bad}
    if large:
        assert {k: v for k, v in got.items() if k != "bytes.jsonl"} == want and got["bytes.jsonl"] == (1, 0)
    else:  # line by line, an object around the bars is one record
        assert {k: got[k] for k in ("array.json", "lines.jsonl", "flat.json")} == {k: want[k] for k in ("array.json", "lines.jsonl", "flat.json")}
    assert read.count() == tolerant.records(read).count() + tolerant.rejects(read).count()
    lines = read.where("path LIKE '%lines.jsonl' AND record IS NULL").orderBy("place").collect()
    assert [r.reject.strip() for r in lines] == ['{"Close":', "plain words"]


def test_bars_of_every_shape(spark, tmp_path):
    for name, (text, _, _) in SHAPES.items():
        (tmp_path / name).write_text(text)
    for name, n in (("array.json", 2), ("nested.json", 1), ("flat.json", 1), ("lines.jsonl", 4)):
        rows = B.read_bars(spark, str(tmp_path / name), name.split(".")[1], "X").collect()
        assert len(rows) == n and {(r.symbol, r.high, r.volume) for r in rows} == {("X", 2.5, 3.0)} and rows[0].ts == dt.datetime(2025, 1, 1)
    assert B.json_rejects(spark, str(tmp_path / "lines.jsonl")).count() == 2
    index = spark.createDataFrame([(str(tmp_path / "array.json"), "AAA_1H", "json"), (str(tmp_path / "none.parquet"), "BBB_1H", "parquet"), (str(tmp_path / "x.xls"), "CCC_1H", "xls")], "path string, key string, ext string")
    with pytest.warns(UserWarning, match="can't be read"):
        assert {r.symbol for r in B.load(spark, index, ["AAA", "BBB", "CCC"], "1h").collect()} == {"AAA"}


def test_log_keeps_what_is_broken(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"symbol": "A", "pnl": 1.5}\n\nnot json\n{"symbol": "B", "pnl": "x"}\n[1]\n{"symbol": "C"')
    rows, bad = portfolio.read_log(spark, str(tmp_path), "symbol string, pnl double")
    assert sorted((r.symbol, r.pnl) for r in rows.collect()) == [("A", 1.5), ("B", None)]
    assert sorted(r.line for r in bad.collect()) == ["[1]", "not json", '{"symbol": "C"']


def test_catalog_reads_each_file_once(spark, tmp_path, monkeypatch):
    source = tmp_path / "in" / "deep"
    source.mkdir(parents=True)
    for i in range(5):
        (source / f"f{i}.csv").write_text(f"text {i % 3}")
    catalog = files.Catalog(spark, f"{tmp_path}/catalog")
    assert catalog.files().count() == 0
    write, calls = Commits.write, []

    def stopped(self, step, tables):
        calls.append(step)
        if len(calls) == 2:
            raise RuntimeError("stop")
        return write(self, step, tables)

    with monkeypatch.context() as m:  # the second of three batches stops the update
        m.setattr(Commits, "write", stopped)
        with pytest.raises(Exception, match="stop"):
            catalog.update(f"{tmp_path}/in", files_a_batch=2)
    assert catalog.files().count() == 2
    catalog.update(f"{tmp_path}/in", files_a_batch=2)
    got = {r.path.rsplit("/", 1)[1]: (r.sha256, r.size_bytes, r.category) for r in catalog.files().collect()}
    assert got == {f"f{i}.csv": (hashlib.sha256(f"text {i % 3}".encode()).hexdigest(), 6, "data") for i in range(5)} and catalog.files().count() == 5
    (source / "late.parquet").write_text("more")
    seen = []
    with monkeypatch.context() as m:
        m.setattr(files, "described", lambda batch, *a, d=files.described: (seen.append([r.path for r in batch.select("path").collect()]), d(batch, *a))[1])
        files.Catalog(spark, f"{tmp_path}/catalog").update(f"{tmp_path}/in")
    assert [p.rsplit("/", 1)[1] for paths in seen for p in paths] == ["late.parquet"] and catalog.files().count() == 6
    assert files.duplicates(catalog.files()).count() == 2


def test_knowledge_grows_by_what_is_new(spark, tmp_path):
    long = lambda i: "\n\n".join(f"Paragraph {i} {k} " + "word " * 60 for k in range(20))
    documents = spark.createDataFrame([(str(i), long(i)) for i in range(6)] + [("none", None), ("short", "tiny")], "doc_id string, text string")
    store = knowledge.KnowledgeStore(spark, f"{tmp_path}/store", 100, 20)
    assert store.check().head().chunks == 0
    assert store.add(documents.where("doc_id < '3'"), "first") and not store.add(documents, "first")
    part = store.chunks().count()
    assert store.add(documents, "second") and store.add(documents, "third")
    whole = docs.chunks(documents, 100, 20)
    assert 0 < part < store.chunks().count() == whole.count()
    assert {r.chunk_key for r in store.chunks().collect()} == {r.chunk_key for r in whole.collect()}
    edited = spark.createDataFrame([("1", long(1) + "\n\nA new end " + "word " * 80)], "doc_id string, text string")
    store.add(edited, "edit")
    assert whole.count() < store.chunks().count() <= whole.count() + 3
    row = store.check().head()
    assert row.chunks == row.chunk_ids and row.documents == 6 and row.empty == 0
    pages = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("a", 3, None), ("b", 1, "x")], "doc_id string, page int, text string")
    assert {tuple(r) for r in knowledge.joined_pages(pages).collect()} == {("a", "one\n\ntwo\n\n"), ("b", "x")}


def test_rows_without_features_are_scored(spark):
    rows = spark.createDataFrame([(float(i % 7) if i % 5 else None, float("nan") if i % 11 == 0 else 1.0, i % 2 if i != 3 else None, "train" if i % 4 else "test") for i in range(120)], "a double, b double, y int, part string")
    scored = learn.train_and_score(rows, ["a", "b"], "y", trees=2, depth=2)
    assert scored.count() == 119 and scored.where("part = 'test'").count() == 30


def test_keywords_without_short_and_stop_words(spark):
    frame = spark.createDataFrame([(1, "The market  market moves with\nprices and prices; zone zone zone"), (2, None), (3, "a an the")], "doc_id long, text string")
    got = [(r.word, r["count"]) for r in docs.keywords(frame, 3).orderBy("rank").collect()]
    assert got == [("zone", 3), ("market", 2), ("moves", 1)]


def test_keywords_shuffle_texts_once(spark):
    """Texts are dealt out by their document, and nothing for each word after that; what counts documents shuffles their words' counts besides."""
    frame = spark.createDataFrame([(i % 5, "alpha beta gamma " * (i + 1)) for i in range(20)], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(docs.keywords(frame, 3)).count("Exchange hashpartitioning(doc_id") == plan(docs.keywords(frame, 3)).count("Exchange ") == 1
    frequency = plan(docs.document_frequency(docs.keywords(frame, 3)))
    assert frequency.count("Exchange hashpartitioning(doc_id") == 1 and [tuple(r) for r in docs.document_frequency(docs.keywords(frame, 3)).collect()] == [("alpha", 5, 1), ("beta", 5, 2), ("gamma", 5, 3)]
