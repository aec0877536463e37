"""Documents to chunks, transcripts, keywords, votes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Beginnings of chapters (fixed values).
CHAPTERS = [re.compile(r"^chapter\s+\d+", re.I | re.M), re.compile(r"^part\s+[IVXLCDM\d]+", re.I | re.M), re.compile(r"^section\s+\d+", re.I | re.M), re.compile(r"^\d+\.\s+[A-Z]", re.M), re.compile(r"^[A-Z][A-Z\s]{10,}$", re.M)]


#: Where a chunk may end: at a mark up to so many characters beyond its size (fixed values).
MARGINS = (("\n\n", 200), (". ", 100))


def spans_of_chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(chapter, start, end) of chunks of about `size` characters that end at paragraphs, else sentences, within chapters."""
    heads = sorted({0, *(m.start() for p in CHAPTERS for m in p.finditer(text))})
    for chapter, (low, high) in enumerate(zip(heads, [*heads[1:], len(text)])):
        if not text[low:high].strip():
            continue
        at = low
        while True:
            end = min(at + size, high)
            if end < high:
                middle = at + size // 2
                for mark, beyond in MARGINS:
                    cut = text.rfind(mark, middle, min(end + beyond, high))
                    if cut > middle:
                        end = cut + 2
                        break
            yield chapter, at, end
            if end >= high:
                break
            at = max(at + 1, end - overlap)


def chunks(documents: DataFrame, size: int = 800, overlap: int = 150, id_col: str = "doc_id", least: int = 50) -> DataFrame:
    """(id, chunk_idx, chapter_idx, start_char, end_char, text, token_estimate, id): chunks of more than `least` characters.

    `size` and `overlap` are tokens of four characters. A map over documents; nothing is shuffled.
    """
    if not 0 <= overlap < size / 2:
        raise ValueError("overlap must be less than half of size")
    schema = f"{id_col} {documents.schema[id_col].dataType.simpleString()}, chunk_idx int, chapter_idx int, start_char int, end_char int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                number = 0
                for chapter, low, high in spans_of_chunks(text or "", size * 4, overlap * 4):
                    piece = text[low:high].strip()
                    if len(piece) > least:
                        rows.append((i, number, chapter, low, high, piece))
                        number += 1
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int32()) for c in columns[1:5]), pa.array(columns[5], pa.string())], names=["id", "chunk_idx", "chapter_idx", "start_char", "end_char", "text"])

    made = documents.select(id_col, "text").mapInArrow(run, schema)
    return made.withColumns({"token_estimate": T.estimate_tokens(F.col("text")), "chunk_key": T.chunk_id(F.col(id_col).cast("string"), F.col("chunk_idx"), F.col("text"))})


def chunk_stats(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return made.groupBy(id_col).agg(F.count("*").alias("n_chunks"), F.avg("token_estimate").alias("avg_tokens"), F.min("token_estimate").alias("min_tokens"), F.max("token_estimate").alias("max_tokens"), F.countDistinct("chapter_idx").alias("n_chapters"))


def keywords(documents: DataFrame, n: int = 10, by: str = "doc_id") -> DataFrame:
    """(by, rank, word, count): most frequent words of more than three letters; ties by first appearance.

    Texts are dealt out by their key once; counts and ranks of a key are made where its texts are, so no row for each word is shuffled.
    """
    split = F.split(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), " ")
    # short and stop words go before there is a row for each; the order of the rest is the same
    words = documents.select(by, "text").repartition(by).select(by, F.posexplode(F.filter(split, lambda w: (F.length(w) > 3) & ~w.isin(T.STOP_WORDS))).alias("at", "word"))
    counted = words.groupBy(by, "word").agg(F.count("*").alias("count"), F.min("at").alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("count"), "first")))
    return ranked.where(F.col("rank") <= n).select(by, "rank", "word", "count")


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count): how often each value of each column occurs; null is a value. One pass, whatever the number of columns."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(F.explode(pairs).alias("p")).select("p.*").groupBy("column", "value").agg(F.count("*").alias("count"))


def distinct_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): numbers of distinct values that are not null, exact."""
    return value_counts(rows, columns).where("value IS NOT NULL").groupBy("column").agg(F.count("*").alias("n"))


def document_frequency(keywords: DataFrame, most: int = 20) -> DataFrame:
    """(word, documents, rank) of the `most` words that are keywords (doc_id, word) of the most documents (a report: the limit is its purpose)."""
    counted = keywords.select("doc_id", "word").distinct().groupBy("word").agg(F.count("*").alias("documents"))
    top = counted.orderBy(F.desc("documents"), "word").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("documents"), "word")))


def transcript_totals(made: DataFrame) -> DataFrame:
    """One row: transcripts, cues, words, hours of transcripts (path, cues, duration_s, words)."""
    return made.agg(F.count("*").alias("transcripts"), F.sum("cues").alias("cues"), F.sum("words").alias("words"), (F.sum("duration_s") / 3600).alias("hours"))


def enrich(made: DataFrame, catalog: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks with what a catalog (one row an id) says of their document; chunks of unknown documents stay, with nulls."""
    return made.join(catalog, id_col, "left")


def verify_index(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row: chunks, distinct ids of chunks, documents, empty chunks: what an index over chunks should hold."""
    return made.agg(F.count("*").alias("chunks"), F.countDistinct("chunk_key").alias("chunk_ids"), F.countDistinct(id_col).alias("documents"), F.sum((F.length("text") == 0).cast("long")).alias("empty"))


def news_votes(headlines: DataFrame, by: str = "symbol") -> DataFrame:
    """(by, sentiment, recommendation, confidence, headlines) of all headlines of a symbol together.

    Words are looked for in each headline and joined by presence, so headlines are never concatenated.
    """
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    count = lambda words, name: F.aggregate(F.array(*[F.max(F.contains(low, F.lit(w)).cast("int")) for w in words]), F.lit(0), lambda a, b: a + b).alias(name)
    out = headlines.groupBy(by).agg(count(T.BULLISH, "up"), count(T.BEARISH, "down"), F.count("*").alias("headlines"))
    out = out.withColumn("sentiment", F.coalesce(F.try_divide((F.col("up") - F.col("down")).cast("double"), F.col("up") + F.col("down")), F.lit(0.0)))
    return out.withColumn("v", T.sentiment_vote(F.col("sentiment"), F.col("headlines"))).select(by, "sentiment", "v.recommendation", "v.confidence", "headlines")


def subtitles(files: DataFrame, kind: str = "srt") -> DataFrame:
    """(path, seq, start, end, text) of subtitle files (path, content)."""
    clean = F.replace(F.col("content"), F.lit("\r\n"), F.lit("\n"))
    blocks = F.posexplode(F.split(F.trim(clean), r"\n\s*\n"))
    rows = files.select("path", blocks.alias("seq", "block")).withColumn("lines", F.split(F.trim("block"), "\n"))
    if kind == "vtt":
        rows = rows.withColumn("lines", F.slice("lines", F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit(" --> "))), F.lit(True)).cast("int") + F.lit(0), F.size("lines"))).where(F.contains("block", F.lit(" --> ")))
        time, text = F.get("lines", 0), F.slice("lines", 2, F.size("lines"))
    else:
        rows = rows.where((F.size("lines") >= 3) & F.contains(F.get("lines", 1), F.lit(" --> ")))
        time, text = F.get("lines", 1), F.slice("lines", 3, F.size("lines"))
    ends = F.split(time, " --> ")
    return rows.select("path", "seq", F.trim(F.get(ends, 0)).alias("start"), F.trim(F.get(ends, 1)).alias("end"), F.trim(F.array_join(text, " ")).alias("text"))


def transcripts(cues: DataFrame) -> DataFrame:
    """(path, cues, duration_s, words): duration is the end of the last cue."""
    return cues.groupBy("path").agg(F.count("*").alias("cues"), T.timecode_seconds(F.max_by("end", "seq")).alias("duration_s"), F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).cast("long").alias("words"))
