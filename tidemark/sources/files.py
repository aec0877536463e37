"""File catalogs: scans, look-ups, roll-ups, duplicates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.commits import Commits

#: Files above so many bytes are hashed from their paths, in blocks of so many.
LARGE, BLOCK = 64 << 20, 1 << 20
#: extension -> category (fixed values).
CATEGORIES = {"csv": "data", "parquet": "data", "json": "data", "jsonl": "data", "pdf": "book", "epub": "book", "djvu": "book", "docx": "book", "png": "image", "jpg": "image", "jpeg": "image", "html": "page", "mp4": "video", "srt": "subtitle", "vtt": "subtitle", "cbm": "model", "pkl": "model", "pt": "model", "onnx": "model", "py": "code"}


def scan(spark: SparkSession, path: str, contents: bool = False, large: int = LARGE) -> DataFrame:
    """path, ext, category, size_bytes, modified (and sha256 of the whole file if `contents`) of all files below a path.

    Files of more than `large` bytes are not loaded: tasks read them from their paths in blocks.
    """
    return described(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), contents, large)


def described(files: DataFrame, contents: bool = False, large: int = LARGE) -> DataFrame:
    """What `scan` says of files as Spark reads them (path, length, modificationTime, content)."""
    named = ["path", extension(F.col("path")).alias("ext"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")]
    if not contents:
        return files.select(*named).withColumn("category", category(F.col("ext")))
    small = files.where(F.col("length") <= large).select(*named, F.sha2("content", 256).alias("sha256"))
    rest = files.where(F.col("length") > large).select(*named)
    streamed = rest.mapInArrow(_hashed, "path string, ext string, size_bytes long, modified timestamp, sha256 string")
    return small.unionByName(streamed).withColumn("category", category(F.col("ext")))


class Catalog:
    """A catalog that grows: each update reads and hashes only the files that no update has seen.

    A file stream remembers the files (by path: one that changes in place is not seen again) and every micro-batch is committed once,
    so an update that stops in the middle is finished by the next one and no file is listed twice.
    """

    def __init__(self, spark: SparkSession, root: str, large: int = LARGE) -> None:
        self.spark, self.root, self.large = spark, root.rstrip("/"), large
        self.commits = Commits(spark, f"{self.root}/files")

    def update(self, path: str, files_a_batch: int = 10_000) -> None:
        """Adds the new files below a path, `files_a_batch` to a commit."""
        source = self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        stream = source.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(path)
        add = lambda batch, number: self.commits.write(number, {"files": described(batch, True, self.large)}) and None
        stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    def files(self) -> DataFrame:
        return self.commits.read_all("files", "path string, ext string, size_bytes bigint, modified timestamp, sha256 string, category string").drop("step")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with sha256 of the files at `path`, read in blocks."""
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            with _opened(path) as file:
                while block := file.read(BLOCK):
                    digest.update(block)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "sha256"])


def _opened(path: str):
    if path.startswith("file:") or path.startswith("/"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    system, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_stream(unquote(name))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def category(ext: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv)), ext), F.lit("other"))


def file_key(path: Column) -> Column:
    """Upper-cased stem of at most 100 characters."""
    return F.substring(F.upper(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")), 1, 100)


def listed_symbols(index: DataFrame) -> DataFrame:
    """symbol, files: what stands before the last `_` of each key, the whole key without one."""
    prefix = F.regexp_replace("key", "_[^_]*$", "")
    return index.select(prefix.alias("symbol")).groupBy("symbol").agg(F.count("*").alias("files"))


def largest(files: DataFrame, n: int = 20) -> DataFrame:
    """The n largest files, with their rank (a report: the limit is its purpose)."""
    order = [F.desc("size_bytes"), F.col("path")]
    return files.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def resolve(index: DataFrame, symbol: str, timeframe: str) -> DataFrame:
    """The one file for a symbol and timeframe: an exact key, else the first that holds the symbol."""
    s, t = symbol.upper(), timeframe.upper()
    exact = [f"{s}_{t}", f"{s}{t}", f"{s}-{t}", f"{s.replace('-', '')}_{t}", f"{s.replace('/', '')}_{t}", s]
    rank = F.coalesce(*(F.when(F.col("key") == k, i) for i, k in enumerate(exact)), F.when(F.contains("key", F.lit(s)), len(exact)))
    return index.withColumn("_rank", rank).where("_rank IS NOT NULL").orderBy("_rank", "key", "path").limit(1).drop("_rank")


def roll_up(files: DataFrame) -> DataFrame:
    """dir, category, files, bytes: counts by both, by directory and in all (nulls are totals)."""
    return files.rollup("dir", "category").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def duplicates(files: DataFrame) -> DataFrame:
    """sha256, copies, wasted bytes of contents that several files have."""
    return files.where("sha256 <> ''").groupBy("sha256").agg(F.count("*").alias("copies"), (F.sum("size_bytes") - F.max("size_bytes")).alias("wasted")).where("copies > 1")


def first_of_each(files: DataFrame) -> DataFrame:
    """Without later files of the same hash; files without a hash all stay."""
    w = Window.partitionBy("sha256").orderBy("path")
    return files.withColumn("_k", F.row_number().over(w)).where((F.col("_k") == 1) | (F.coalesce("sha256", F.lit("")) == "")).drop("_k")


def top_extensions(files: DataFrame, by: str, n: int) -> DataFrame:
    counted = files.groupBy(by, "ext").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    w = Window.partitionBy(by).orderBy(F.desc("files"), "ext")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def unprocessed(files: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    return files.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both; a key of both has the new row."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
