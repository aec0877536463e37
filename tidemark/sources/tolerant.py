"""JSON of any usual shape, read without losing what can't be read: records and rejects come out of one pass."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys under which nested JSON keeps its records, in the order they are looked for (fixed values).
NESTED = ("data", "candles", "result", "results", "ohlcv", "bars", "chart")
#: Files of more bytes are read line by line, split among tasks.
WHOLE = 128 << 20
RECORDS = "path string, place bigint, record map<string,string>, reject string"


def _text(value: object) -> str | None:
    """A value as text: strings as they are, other things as JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _record(value: object) -> dict[str, str | None] | None:
    """Fields by their names in lower case; None for what is no object."""
    return {str(k).strip().lower(): _text(v) for k, v in value.items()} if isinstance(value, dict) else None


def records_of(raw: str) -> Iterator[tuple[dict[str, str | None] | None, str | None]]:
    """(record, reject) of a whole file: an array, an object with an array under a key of NESTED, one flat object, or lines of JSON.

    What is no object, and lines that are no JSON, are rejects.
    """
    try:
        found = json.loads(raw)
    except ValueError:
        for line in raw.splitlines():
            yield from records_of_line(line)
        return
    if isinstance(found, dict):
        found = next((found[k] for k in NESTED if isinstance(found.get(k), list)), [found])
    for item in found if isinstance(found, list) else [found]:
        record = _record(item)
        yield record, None if record is not None else _text(item) or "null"


def records_of_line(line: str) -> Iterator[tuple[dict[str, str | None] | None, str | None]]:
    """(record, reject) of one line: an object, or an array of them; blank lines are nothing."""
    if line.strip():
        try:
            found = json.loads(line)
        except ValueError:
            yield None, line
            return
        for item in found if isinstance(found, list) else [found]:
            record = _record(item)
            yield record, None if record is not None else _text(item) or "null"


def read_json(spark: SparkSession, path: str, large: int = WHOLE) -> DataFrame:
    """RECORDS of the files at or below a path: each record's fields as text, or what could not be read; `place` counts within a file.

    Files of up to `large` bytes may have any shape of `records_of`; larger ones are taken line by line, and their lines are dealt to
    tasks (places are those of bytes then, in order all the same). Bytes that are no text are replaced.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    whole = files.where(F.col("length") <= large).select("path", "content")
    big = [r.path for r in files.where(F.col("length") > large).select("path").collect()]  # names of large files, few by their size

    def by_file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                rows = [(name, i, r, bad) for i, (r, bad) in enumerate(records_of(bytes(content).decode("utf-8-sig", "replace")))]
                for at in range(0, len(rows), 50_000):
                    yield pd.DataFrame(rows[at : at + 50_000], columns=["path", "place", "record", "reject"])

    def by_line(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, i, r, bad) for p, i, line in zip(frame["path"], frame["place"], frame["value"]) for r, bad in records_of_line(bytes(line).decode("utf-8-sig", "replace"))]
            yield pd.DataFrame(rows, columns=["path", "place", "record", "reject"])

    out = whole.mapInPandas(by_file, RECORDS)
    if big:
        lines = spark.read.text(big).select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") * 4096 + F.monotonically_increasing_id() % (1 << 33)).alias("place"), F.col("value").cast("binary").alias("value"))
        out = out.unionByName(lines.mapInPandas(by_line, RECORDS))
    return out


def records(read: DataFrame) -> DataFrame:
    return read.where("record IS NOT NULL").drop("reject")


def rejects(read: DataFrame) -> DataFrame:
    """path, place, reject: what is no record, as it stood in the file."""
    return read.where("record IS NULL").select("path", "place", "reject")


def as_columns(read: DataFrame, names: list[str]) -> DataFrame:
    """path, place and the named fields of records as columns of text, null where a record lacks them."""
    return records(read).select("path", "place", *(F.try_element_at("record", F.lit(n)).alias(n) for n in names))
