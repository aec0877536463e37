"""Quality classifier: zstandard dictionaries of good and of bad text; the difference of compressed sizes is a score.

Two dictionaries are trained from labelled text, one a class. A text is cut into chunks of CHUNK bytes and each chunk is
compressed with either dictionary; (bad - good) / length is the normalised difference, summed over the whole text so
that long texts are judged like short ones. A logistic fit on labelled texts that no dictionary has seen
calibrates it, together with the good size per byte (repetition compresses with any dictionary), the worst
chunk's difference and the inverse length. Fitting reads at most SAMPLE labelled texts a class and brings to the driver
pieces of these, chosen by hash from all of a text, PIECES of PIECE characters at most; what the calibration
sees of a text is computed from all of it, in tasks. Scoring reads every whole text and is a map over rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm.common import release, stored

CHUNK, DICTIONARY, LEVEL = 1024, 65536, 1
#: Bound of the sample that the classifier is fitted on: labelled texts a class; pieces of each for the dictionaries, their characters.
SAMPLE, PIECES, PIECE = 4000, 12, 1024


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows whose labels are never learned from: crc32(id as text) mod 3 = 1. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _chunks(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


def _dictionary(texts: list[str]) -> bytes:
    chunks = [c for t in texts for c in _chunks(t.encode()) if len(c) > 30]
    try:
        return zstandard.train_dictionary(DICTIONARY, chunks).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: they are the dictionary themselves
        return b"".join(chunks)[:DICTIONARY] or b" " * 16


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False)


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def features(self, texts: list[str]) -> np.ndarray:
        """A row for each text: 1, difference, worst chunk's difference, good size (each by length), 1 / length."""
        good, bad = _compressor(self.good), _compressor(self.bad)
        rows = np.zeros((len(texts), 5))
        for row, text in zip(rows, texts):
            if not (data := text.encode("utf-8", "surrogatepass")):
                continue
            sizes = np.array([(len(good.compress(c)), len(bad.compress(c)), len(c)) for c in _chunks(data)], dtype=float)
            differences = sizes[:, 1] - sizes[:, 0]
            row[:] = 1, differences.sum() / len(data), (differences / sizes[:, 2]).min(), sizes[:, 0].sum() / len(data), 1 / len(data)
        return rows

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1; 0 for empty texts."""
        rows = self.features(texts)
        return np.where(rows[:, 0] > 0, 1 / (1 + np.exp(-np.clip(rows @ np.array(self.weights), -500, 500))), 0.0)


def _logistic(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps on standardised columns, given back on the raw ones."""
    mean, scale = rows.mean(0), rows.std(0)
    mean[0], scale = 0.0, np.where(scale > 0, scale, 1.0)
    x, w = (rows - mean) / scale, np.zeros(rows.shape[1])
    loss = lambda w: (weights * np.logaddexp(0, np.where(labels == 1, -1, 1) * (x @ w))).sum() + ridge * (w @ w) / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weights * (labels - p)) - ridge * w)
        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    raw = w / scale
    raw[0] = w[0] - (w[1:] * mean[1:] / scale[1:]).sum()
    return raw


def _untrained(train: dict[int, list[str]]) -> QualityModel:
    """Dictionaries of texts by class, not yet calibrated."""
    # lines that several good texts share are boilerplate of either class; they would be learned by heart
    shared = Counter(line for t in train[1] for line in set(t.split("\n")))
    kept = lambda t, most: "\n".join(line for line in t.split("\n") if shared[line] <= most)
    return QualityModel(_dictionary([kept(t, 1) for t in train[1]]), _dictionary([kept(t, 0) for t in train[0]]), (0.0,) * 5)


def _one_class(label: int) -> QualityModel:
    """For labels of one class only: everything is of that class."""
    return QualityModel(b" " * 16, b" " * 16, (20.0 if label else -20.0, 0.0, 0.0, 0.0, 0.0))


def fit(labelled: list[tuple[str, int, float]]) -> QualityModel:
    """`labelled`: text, label, weight of its class; every other text of a class trains dictionaries, the rest calibrate."""
    by = {k: [x for x in labelled if x[1] == k and x[0]] for k in (0, 1)}
    if not by[0] or not by[1]:
        return _one_class(1 if by[1] else 0)
    model = _untrained({k: [t for t, *_ in by[k][::2]] for k in by})
    rest = [x for k in by for x in by[k][1::2] or by[k]]
    labels, weights = np.array([y for _, y, _ in rest]), np.array([w for *_, w in rest])
    return QualityModel(model.good, model.bad, tuple(map(float, _logistic(model.features([t for t, *_ in rest]), labels, weights))))


@F.pandas_udf(StringType())
def _pieces(texts: pd.Series) -> pd.Series:
    """PIECES pieces of each text, those with the least hashes, in their order; a text that has no more stays whole."""

    def chosen(text: str) -> str:
        if len(text) <= PIECES * PIECE:
            return text
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        least = sorted(range(len(pieces)), key=lambda i: (xxhash.xxh64_intdigest(pieces[i].encode("utf-8", "surrogatepass")), i))[:PIECES]
        return "".join(pieces[i] for i in sorted(least))

    return texts.map(chosen)


def fit_quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fits on a bounded sample of the labelled rows that are not held out: per class the `sample` with the smallest hashes.

    Rows with a null id or label are no labels; of repeated ids the larger label and the least text count. The driver
    gets pieces of the texts that train dictionaries (at most `sample` * PIECES * PIECE characters in all) and five
    numbers of each text that calibrates, computed from all of it. Without labelled texts everything is bad.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    few = [known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    few = F.broadcast(few[0].unionByName(few[1]))  # at most 2 * sample rows
    texts = documents.select("doc_id", "text").where("text <> ''").join(few, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    own = Window.partitionBy("quality")
    ranked = texts.select("*", F.row_number().over(own.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("rank"), F.count("*").over(own.orderBy(F.lit(0))).alias("n"))
    ranked = stored(ranked, "labelled")
    train: dict[int, list[str]] = {0: [], 1: []}
    for r in ranked.where("rank % 2 = 1").select("quality", "rank", _pieces("text").alias("text")).orderBy("quality", "rank").collect():
        train[r.quality].append(r.text)
    if not train[0] or not train[1]:
        return _one_class(1 if train[1] else 0)
    model = _untrained(train)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.features(texts.tolist())))

    rest = ranked.where("rank % 2 = 0 OR n = 1").select("quality", "rank", "n", features("text").alias("row")).orderBy("quality", "rank").collect()
    release(ranked)
    used = {r.quality: r.n for r in rest}
    rows, ys = np.array([r.row for r in rest]), np.array([r.quality for r in rest])
    weights = np.array([counts[r.quality] / used[r.quality] * sum(used.values()) / sum(counts.values()) for r in rest])
    return QualityModel(model.good, model.bad, tuple(map(float, _logistic(rows, ys, weights))))


def score_quality(documents: DataFrame, model: QualityModel, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """`documents` with `score` (0 to 1) and `predicted` (1 if the score is 0.5 or more, else 0) in place of columns of these names.

    Null texts count as empty, and empty texts score 0; a text is scored whole, however long. Every row stays, repeated ones too;
    an empty table gives no rows.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts.fillna("").tolist()))

    return documents.withColumn(score, scored("text")).withColumn(predicted, (F.col(score) >= 0.5).cast("int"))
