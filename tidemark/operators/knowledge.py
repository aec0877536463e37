"""A store of chunks that is built step by step: what is there is not made again, and a stop loses nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.text import chunks, verify_index
from tidemark.sources.commits import Commits

CHUNKS = "doc_id string, chunk_idx int, chapter_idx int, start_char int, end_char int, text string, token_estimate bigint, chunk_key string"


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc_id, text: the pages (doc_id, page, text) of each document in order, with an empty line between; null pages count as empty."""
    ordered = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"))


class KnowledgeStore:
    """Chunks of documents below a folder that all executors share.

    A chunk's key comes from its document, its place and its text, so a document that comes again unchanged adds nothing and one that
    was edited adds the chunks that are new. Each batch of documents is committed once, under its name.
    """

    def __init__(self, spark: SparkSession, root: str, size: int = 800, overlap: int = 150) -> None:
        self.spark, self.size, self.overlap = spark, size, overlap
        self.commits = Commits(spark, root)

    def chunks(self) -> DataFrame:
        return self.commits.read_all("chunks", CHUNKS).drop("step")

    def add(self, documents: DataFrame, name: str) -> bool:
        """Adds the chunks of documents (doc_id, text) that are not there; False, without reading them, if the batch was committed before."""
        if self.commits.done(name):
            return False
        made = chunks(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), self.size, self.overlap)
        made = made.withColumn("token_estimate", F.col("token_estimate").cast("long")).dropDuplicates(["chunk_key"])
        return self.commits.write(name, {"chunks": made.join(self.chunks().select("chunk_key"), "chunk_key", "left_anti").select(*(c.split()[0] for c in CHUNKS.split(", ")))})

    def check(self) -> DataFrame:
        """One row: chunks, distinct keys, documents, empty chunks."""
        return verify_index(self.chunks())
