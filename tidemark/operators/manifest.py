"""Image manifests: labels from paths, from other tables, from titles; samples per label."""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T


def label_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """files with label (pattern), direction, category: the label, else the direction, else unlabeled."""
    df = files.withColumns({"label": T.chart_pattern(F.col(path)), "direction": T.chart_direction(F.col(path))})
    category = F.when(F.col("label") != "unlabeled", F.col("label")).when(F.col("direction") != "unknown", F.col("direction")).otherwise("unlabeled")
    return df.withColumn("category", category)


def merge_results(manifest: DataFrame, results: DataFrame, key: str = "path") -> DataFrame:
    """manifest with results' label and status where there is one; other rows are pre_labeled."""
    r = results.select(key, F.col("label").alias("_label"), F.col("status").alias("review_status"))
    joined = manifest.join(r, key, "left")
    return joined.withColumns({"label": F.coalesce("_label", "label"), "review_status": F.coalesce("review_status", F.lit("pre_labeled"))}).drop("_label")


def apply_cluster_labels(manifest: DataFrame, placed: DataFrame, names: DataFrame, key: str = "path") -> DataFrame:
    """manifest labelled by cluster (placed: key, cluster_id; names: cluster_id, name); clusters with empty names change nothing."""
    named = placed.join(names.where(F.coalesce(F.trim("name"), F.lit("")) != ""), "cluster_id").select(key, F.col("name").alias("_name"))
    joined = manifest.join(named, key, "left")
    return joined.withColumns({"changed": F.coalesce(F.col("_name") != F.col("label"), F.lit(False)), "label": F.coalesce("_name", "label")}).drop("_name")


def title_similarity(a: str, b: str) -> float:
    """Ratio of matching blocks; where one holds the other, at least half and a half of the lengths' ratio."""
    score = difflib.SequenceMatcher(None, a, b).ratio()
    return max(score, 0.5 + 0.5 * min(len(a), len(b)) / max(len(a), len(b))) if a in b or b in a else score


#: Letters whose counts bound how alike two titles can be; everything else counts together.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Tasks among which the titles of one range of lengths are dealt.
TITLE_SALTS = 32


def _lettered(column: str) -> list[Column]:
    """Length, and how often each of LETTERS and anything else stands in the column."""
    chars = F.split(F.col(column), "")
    counts = F.transform(F.array(*map(F.lit, LETTERS)), lambda x: F.size(F.filter(chars, lambda c: c == x)))
    rest = F.length(column) - F.aggregate(counts, F.lit(0), lambda s, n: s + n)
    return [F.length(column).alias("n"), F.concat(counts, F.array(rest)).alias("letters")]


def title_candidates(titles: DataFrame, library: DataFrame, threshold: float) -> DataFrame:
    """title, book, position: pairs that can be alike to `threshold`; no pair that is gets lost.

    Matching blocks hold at most the letters that both have, so 2 * common / (both lengths) bounds the ratio; a title that holds another
    has all of its letters. Either needs lengths near each other, so titles meet books of their own and the neighbouring
    ranges of lengths only.
    """
    near = max(min(threshold / (2 - threshold), 2 * threshold - 1), 0.15)  # the least ratio of lengths that can reach the threshold
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(1 / near))
    own = titles.select("title", *_lettered("title")).withColumns({"band": band(F.col("n")), "salt": F.pmod(F.xxhash64("title"), F.lit(TITLE_SALTS))}).alias("t")
    books = library.select("book", "position", *_lettered("book")).where("n > 0")
    books = books.withColumns({"band": F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: band(F.col("n")) + i))}).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TITLE_SALTS - 1).cast("long")))).alias("b")
    a, b = F.col("t.n"), F.col("b.n")
    common = F.aggregate(F.zip_with("t.letters", "b.letters", lambda x, y: F.least(x, y)), F.lit(0), lambda s, n: s + n)
    bound = F.greatest(2.0 * common / (a + b), F.when(common == F.least(a, b), 0.5 + 0.5 * (F.least(a, b) / F.greatest(a, b))))
    fits = (a / b >= 0.15) & (a / b <= 6.0) & (F.least(a, b) >= near * F.greatest(a, b) * (1 - 1e-9))
    joined = own.join(books, (F.col("t.band") == F.col("b.band")) & (F.col("t.salt") == F.col("b.salt")) & fits)
    return joined.where(bound >= threshold).select("title", "book", "position")


def match_titles(titles: DataFrame, library: DataFrame | list[str], threshold: float = 0.60) -> DataFrame:
    """(title, book, score): the most similar of the library's titles, of equals the first by position, if it reaches the threshold.

    library: a table of book, position (an order of the books), or a list of titles in order; empty and null ones match nothing. Titles (column
    `title`) are distinct, of five letters or more. Only pairs that letters and lengths leave possible are compared.
    """
    if isinstance(library, list):
        library = titles.sparkSession.createDataFrame([(b, i) for i, b in enumerate(library)], "book string, position long")
    pairs = title_candidates(titles.where(F.length("title") >= 5).select("title").distinct(), library, threshold)

    @F.pandas_udf("double")
    def similarity(titles: pd.Series, books: pd.Series) -> pd.Series:
        return pd.Series([title_similarity(a, b) for a, b in zip(titles, books)], dtype=float)

    scored = pairs.withColumn("score", similarity("title", "book")).where(F.col("score") >= threshold)
    best = scored.groupBy("title").agg(F.max_by(F.struct("book", "score"), F.struct("score", -F.col("position"))).alias("best"))
    return best.select("title", "best.book", "best.score")


def books_of_images(images: DataFrame, library: DataFrame, threshold: float = 0.60) -> DataFrame:
    """images (path) with title, book, topic, score: the book of the library (book, position, topic) that the image's name says it is from.

    The title in the name and the names of books are normalised; each distinct title is looked up once. Images without a title or a
    book stay, with nulls.
    """
    name = F.substring_index("path", "/", -1)
    titled = images.withColumn("title", T.title_of_image(name)).withColumn("_plain", T.normalize_book_title(F.col("title")))
    books = library.select(T.normalize_book_title(F.regexp_replace("book", r"\.[^.]*$", "")).alias("book"), "position", F.col("book").alias("_file"), F.col("topic").alias("_topic"))
    found = match_titles(titled.where("_plain IS NOT NULL").select(F.col("_plain").alias("title")), books.select("book", "position"), threshold)
    first = books.groupBy("book").agg(F.min_by(F.struct("_file", "_topic"), "position").alias("_f"))
    known = found.join(first, "book").select(F.col("title").alias("_plain"), F.col("_f._file").alias("book"), F.col("_f._topic").alias("topic"), "score")
    return titled.join(known, "_plain", "left").drop("_plain")


def directory_topics(files: DataFrame, topics: DataFrame, depth: int = 3, path: str = "path") -> DataFrame:
    """files (paths below one folder) with `topic`: that of the nearest directory above them that `topics` (name, topic) holds, else null.

    Names are compared in lower case without spaces around them; files more than `depth` directories deep have none. The
    topic table is made by hand, one row a name; a file's directories are at most `depth` rows.
    """
    parts = F.split(F.ltrim(F.col(path), F.lit("/")), "/")
    above = F.slice(parts, 1, F.size(parts) - 1)
    each = files.select(path, above.alias("above")).distinct().where(F.size("above") <= depth).select(path, F.posexplode("above").alias("at", "name"))
    named = each.withColumn("name", F.trim(F.lower("name"))).join(topics.select(F.trim(F.lower("name")).alias("name"), "topic"), "name")
    found = named.groupBy(path).agg(F.max_by("topic", "at").alias("topic"))
    return files.join(found, path, "left")


def write_splits(manifest: DataFrame, path: str, part: str = "part") -> None:
    """CSV with a header below a path, a folder for each part (train, val, test)."""
    manifest.write.mode("overwrite").option("header", True).partitionBy(part).csv(path)


def sample_per_label(manifest: DataFrame, label: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows of each label, chosen by a hash (a sampling operator: the limit is its purpose)."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return manifest.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")
