"""Periodic runs, license notices and hard negatives against brute force; a mix and a classifier recomputed by hand."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, hard_negatives, jaccard_join, licenses, mixing, periodic, quality, queries

SF = "/root/testdata/sf0.001"
EMPTY = "doc_id long, text string, runs string, spans string, n_words string, collapsed int"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def brute_runs(words):
    """(start, length, period) of every run, by trying every period."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        x = 0
        while x < len(words) - q:
            start = x
            while x < len(words) - q and words[x] == words[x + q]:
                x += 1
            length = x - start + q
            part = words[start : start + length]
            if x > start and length >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((start, length, q))
            x += x == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng, n):
    words = [str(rng.randrange(rng.choice([1, 2, 3, 30]))) for _ in range(n)]
    for _ in range(rng.randrange(3) if n > 8 else 0):
        a = rng.randrange(n - 1)
        p = rng.randrange(1, max(2, (n - a) // 3))
        for i in range(a, rng.randrange(a, n) + 1):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("least, times", [(6, 4), (3, 3), (12, 5)])
def test_runs_of_many_sequences(least, times):
    rng = random.Random(least)
    for _ in range(1500):
        words = periodic_words(rng, rng.randrange(90))
        got = periodic.find_runs(periodic.numbered([w.encode() for w in words]), least, times)
        if (least, times) == (6, 4):
            assert got == brute_runs(words), words
        for s, k, q in got:
            assert k >= max(least, times * q) and all(words[i] == words[i + q] for i in range(s, s + k - q))
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(9, dtype=np.int64), 6, 2)


def test_runs_of_long_texts_with_many_seeds():
    one = np.zeros(50_000, dtype=np.int64)
    assert periodic.find_runs(one) == [(0, 50_000, 1)]
    blocks = np.array(([0] * 100 + [1]) * 100)
    assert (0, 10_100, 101) in periodic.find_runs(blocks) and len(periodic.find_runs(blocks)) == 101
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert periodic.find_runs(np.array(b[:3000])) == brute_runs(b[:3000])


def changed(doc_id, text):
    """The words that op13 judges."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_periodic_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_periodic_runs(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    n_runs = 0
    for r in got:
        words = changed(r.doc_id, texts[r.doc_id])
        runs = brute_runs(words)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        longest = min(((-k, s, q) for s, k, q in runs), default=None)
        want = (-longest[1] * -1, -longest[0], longest[2], 1000 * -longest[0] // longest[2]) if longest else (None,) * 4
        assert (r.n_runs, (r.start, r.length, r.period, r.exponent_milli)) == (len(runs), want)
        assert r.runs_sha256 == sha("".join(f"{s},{k},{q}\n" for s, k, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        n_runs += len(runs)
    assert n_runs >= 10


def test_periodic_runs_of_awkward_rows(spark):
    rows = [(1, None), (1, ""), (2, " \t\n"), (None, "a a a a a a a"), (None, "a a a a a a a"), (3, "\x1ca b " * 5), (4, "é ß ñ " * 4000 + "x"), (5, "a a a a a")]
    frame = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], EMPTY)
    out = periodic.periodic_runs(frame)
    assert sorted(out.columns) == sorted(frame.columns)
    got = sorted((str(r.doc_id), r.collapsed, [tuple(x) for x in r.runs]) for r in out.collect())
    assert got == sorted([("1", "", []), ("1", "", []), ("2", "", []), ("3", "\x1ca b", [(0, 10, 2)]), ("4", "é ß ñ x", [(0, 12000, 3)]), ("5", "a a a a a", []), ("None", "a", [(0, 7, 1)]), ("None", "a", [(0, 7, 1)])])
    assert periodic.periodic_runs(frame.where("false")).count() == 0
    digest = {r.doc_id: r for r in queries.runs_digest(out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    assert digest[1].n_runs == 0 and digest[1].start is None and digest[1].runs_sha256 == sha("") == digest[1].collapsed_sha256
    shown = spark.createDataFrame([(i, "a b c d e f g h i j") for i in range(200)] + [(None, "a b"), (7, None)], "doc_id long, text string")
    got = shown.select("doc_id", "text", queries.periodic_text(F.col("doc_id"), F.col("text")).alias("t")).collect()
    assert all((r.t or "").split() == (changed(r.doc_id, r.text) if r.doc_id is not None else r.text.split()) for r in got)


def least_edits(notice, text):
    """Least edits between the notice and any passage of the text."""
    row, best = list(range(len(notice) + 1)), len(notice)
    for c in text:
        new = [0]
        for i, x in enumerate(notice):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_notices_against_edit_distances():
    """A notice is found where a passage lies within its edits, with the least number of them, and nowhere else."""
    rng = random.Random(3)
    scanners = [(n, licenses.Scanner([n])) for n in (licenses.Notice.fuzzy(*x) for x in licenses.NOTICES)]
    hits = 0
    for _ in range(250):
        notice, scanner = rng.choice(scanners)
        text = list(notice.text)
        for _ in range(rng.randrange(notice.edits + 3)):
            at, kind = rng.randrange(len(text)), rng.randrange(3)
            text[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("abcdefgh ")]
        around = " ".join(rng.choice(["foo", "under", "license", "the", "bar"]) for _ in range(rng.randrange(6)))
        text = f"{around} {''.join(text)} {around}"
        n, joined = licenses.joined_words(text)
        least = least_edits(notice.text, joined)
        found = scanner.scan(text)
        assert found[0] == n and min((s["edits"] for s in found[1]), default=None) == (least if least <= notice.edits else None), text
        hits += bool(found[1])
    assert hits > 100


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for label, p in queries.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), places


def test_license_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op11_licenses(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        n, places = brute_phrases(texts[r.doc_id])
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({k for _, k in places})) and {k for _, k in places} <= set(r.labels.split(",")) | {""}
        assert (r.score == 1.0 if places else 0 <= r.score <= 1) and bool(r.labels) == (r.score > 0)


def test_licenses_of_awkward_rows(spark):
    mit = "Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software"
    rows = [
        (1, None), (1, ""), (2, "Under the M.I.T. License under the MIT license under the mit-license"), (3, mit), (3, mit),
        (4, "x " * 50_000 + "Licensed under the Apache Licence, Version 2.O."), (5, "under the mit licenses"), (None, "CC-BY-NC 4.0, cc by nc"),
        (6, "This work is licensed under the GNU General Public License, version 3."), (7, "é\x00\x7fß ünder the license of the house"),
    ]
    frame = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], EMPTY)
    notices = [licenses.Notice.exact(*p) for p in queries.PHRASES] + [licenses.Notice.fuzzy(*n) for n in licenses.NOTICES]
    out = licenses.scan_licenses(frame, notices)
    assert sorted(out.columns) == sorted(frame.columns)
    got = {r.doc_id: r for r in out.collect()}
    tell = lambda r: [(s.label, s.exact, s.first_word, s.last_word, s.edits) for s in r.spans]
    assert tell(got[1]) == [] and got[1].n_words == 0
    assert [x for x in tell(got[2]) if x[1]] == [("mit", True, 6, 9, 0), ("mit", True, 10, 13, 0)]
    assert tell(got[3]) == [("mit", False, 0, 15, 0)] and mit[got[3].spans[0].start : got[3].spans[0].end] == mit
    assert tell(got[4]) == [("apache-2", False, 50_000, 50_007, 2)]
    assert [x for x in tell(got[5]) if x[1]] == []
    assert [x[:3] for x in tell(got[None]) if x[1]] == [("cc-by-nc", True, 0), ("cc-by-nc", True, 5)]
    assert tell(got[6]) == [("gpl-3", False, 3, 11, 0)] and tell(got[7]) == []
    assert licenses.scan_licenses(frame.where("false")).count() == 0
    assert licenses.scan_licenses(frame, []).where("size(spans) > 0").count() == 0
    same = queries.license_digest(out.where("doc_id = 3")).collect()
    assert [(r.n_base, r.first_word, r.base_labels, r.labels, r.score) for r in same] == [(0, None, "", "mit", 1.0)] * 2


def brute_negatives(rows, positives=5, negatives=10, low=30, high=90):
    """rows: id, label, vector, is anchor."""
    width = max((len(v) for _, _, v, _ in rows), default=0)
    whole = [(i, k, np.floor(256 * np.array([*v, *[0.0] * (width - len(v))])), a) for i, k, v, a in rows]
    order = lambda x: (-x[0], x[1] is None, x[1])
    out = []
    for at, (i, k, v, anchor) in enumerate(whole):
        if anchor:
            scored = [(int(v @ w), j, m) for b, (j, m, w, _) in enumerate(whole) if b != at]
            for p, pid, _ in sorted((s for s in scored if s[2] == k), key=order)[:positives]:
                fits = sorted((s for s in scored if s[2] != k and low * p <= 100 * s[0] <= high * p), key=order)[:negatives]
                out += [(i, pid, r, j, p, s) for r, (s, j, _) in enumerate(fits, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("rounds", [(8, 64, 256), (1, 2, 3, 256)])
def test_hard_negatives_of_clusters(spark, monkeypatch, rounds):
    """Tight clusters, so that bounds leave lists out; equal vectors and scores, ids that repeat or are null, several blocks and slices."""
    monkeypatch.setattr(hard_negatives, "ROUNDS", rounds)
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "SLICE", 9)
    gen = np.random.default_rng(5)
    centres = gen.normal(size=(6, 8))
    rows = []
    for i in range(500):
        v = centres[i % 6] + 0.05 * gen.normal(size=8) if i % 3 else centres[0]
        rows.append((None if i % 50 == 7 else i % 400, int(gen.integers(3)), [float(x) for x in v[: 8 - i % 2]], i % 20 == 0))
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, is_anchor boolean").withColumn("cell", F.lit("x")).repartition(3)
    out = hard_negatives.hard_negatives(frame, F.col("is_anchor"))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(str(tuple(r)) for r in out.collect())
    assert got == brute_negatives(rows) and len(got) > 500


def test_lists_without_the_window_are_left_out(spark):
    """Anchors visit fewer lists than there are, and the bound never hides a row (the test above)."""
    gen = np.random.default_rng(1)
    centres = 4 * gen.normal(size=(20, 16))
    rows = [(i, i % 2, [int(x) for x in 100 * (centres[i % 20] + 0.02 * gen.normal(size=16))]) for i in range(2000)]
    table = spark.createDataFrame(rows, "id long, label int, vec array<int>").withColumn("row", F.col("id")).cache()
    lists = hard_negatives.inverted_lists(table, 16, 2000)
    anchors = table.where("id % 100 = 0").selectExpr("id AS anchor", "id AS anchor_id", "label", "vec", "0 AS slice", "array(named_struct('goal', 0, 'low', 400000L, 'high', 500000L, 'least', CAST(NULL AS BIGINT))) AS goals")
    visited = hard_negatives._visits(anchors, lists, 16, 0, 256).count()
    assert lists.rows.count() == 2000 and 0 < visited < 0.8 * 20 * (lists.radii >= 0).sum()


def test_hard_negatives_of_awkward_rows(spark):
    kind = "vec_id long, label int, embedding array<float>"
    anchor = F.col("vec_id") % 100 == 0
    mine = lambda rows: sorted(str(tuple(r)) for r in hard_negatives.hard_negatives(spark.createDataFrame(rows, kind), anchor).collect())
    assert mine([]) == [] and mine([(0, 1, None), (1, None, [1.0]), (2, 1, [None]), (3, 1, [float("nan")]), (4, 2, [float("inf")])]) == []
    assert mine([(0, 1, [1.0])]) == [] and mine([(5, 1, [1.0]), (6, 1, [1.0])]) == []
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0]), (2, 2, [0.5, 0.5]), (3, 2, []), (None, 2, [0.5, 0.1]), (100, 2, [0.0, -1.0]), (4, 1, [-1.0, 0.0])]
    assert mine(rows) == brute_negatives([(i, k, v, i is not None and i % 100 == 0) for i, k, v in rows])
    assert mine(rows + [(9, 1, None), (200, None, [1.0])]) == mine(rows)
    with pytest.raises(ValueError, match="exactly"):
        mine([(0, 1, [3e30]), (1, 1, [1.0])])
    assert hard_negatives.hard_negatives(spark.createDataFrame([(0, "a", []), (1, "a", []), (2, "b", [])], kind.replace("int", "string")), anchor).count() == 1


def test_mix_of_repeated_ids(spark):
    """Ids of several sizes, copies and null ids: no row goes above the cap or below none, and targets are met."""
    rng = random.Random(2)
    rows = [(i // 2, "x " * rng.randrange(5, 40), f"s{i % 2}") for i in range(48)] + [(None, "y " * 7, "s0")] * 400 + [(7, "z " * 11, "s2")] * 300
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(frame).toPandas()
    assert len(out) == len(rows) and out["copies"].between(0, 3).all() and (out["taken"] == out["copies"] * out["size"]).all()
    for _, g in out.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= max(0.005 * g["target"].iloc[0], 2), g["source"].iloc[0]
    again = mixing.mix(frame.repartition(5)).toPandas()
    seen = lambda f: sorted(map(str, f.assign(rate=f["rate"].round(9)).astype(object).values.tolist()))
    assert seen(again) == seen(out)


def test_quality_scores_recomputed_from_zstandard_alone(spark):
    """Dictionary sizes, features and the logistic value of a fitted model for some whole texts."""
    import zstandard

    model = quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").select("text").collect()] + ["a", "é" * 50_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score_quality(frame, model).collect()}
    compress = lambda words, piece: len(zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=False, write_dict_id=False).compress(piece))
    for i, text in enumerate(texts):
        data = text.encode()
        pieces = [data[k : k + 1024] for k in range(0, len(data), 1024)]
        sizes = [(compress(model.good, p), compress(model.bad, p), len(p)) for p in pieces]
        difference, worst = sum(b - g for g, b, _ in sizes) / len(data), min((b - g) / n for g, b, n in sizes)
        value = np.dot(model.weights, [1, difference, worst, sum(g for g, _, _ in sizes) / len(data), 1 / len(data)])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-value)), abs=1e-9)


def test_chats_and_joins_of_nothing(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(turns).count() == 0 and queries.chat_digest(chat.format_conversations(turns)).count() == 0
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), k=3, tenths=9).count() == 0
