"""Token counts: totals by source, language and tokenizer version, kept up to date by signed changes.

A batch of changes is reduced to one signed delta per (source, lang, version) and committed as a folder of its own:
written under a temporary name and renamed, so a batch is there whole or not at all, and a batch that
is there already is not committed again. Totals are sums of deltas. `compact` folds committed batches into one folder
that also lists the batches it covers: totals are the newest fold and the batches not on its list, so a stop
anywhere in `compact` changes no total and no batch is ever counted twice.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the pattern that cuts text before byte-pair merges of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ["source", "lang", "version"]
DELTA = "source string, lang string, version string, docs long, tokens long"


@cache
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, path: str, text_col: str = "text", to: str = "tokens") -> DataFrame:
    """`documents` with the number of tokens of every whole text; `path`: a rank file that every executor can open.

    Null and empty texts have none. Strings of special tokens are ordinary text. A text is encoded whole, however long. Repeated
    rows stay; an empty table gives no rows; a column named `to` is replaced, all others stay.
    """

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path)
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts.fillna("")], dtype="int64")

    return documents.withColumn(to, counted(text_col))


class TokenRollup:
    """Totals in a folder that all executors share. For one writer at a time; readers at any time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _named(self, prefix: str) -> list[str]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))

    def _newest(self) -> tuple[str | None, set[str]]:
        """Folder of the newest fold, and the batches it covers."""
        if not (folds := self._named("fold-")):
            return None, set()
        folder = f"{self.path}/fold-{folds[-1]}"
        return folder, {r.batch for r in self.spark.read.schema("batch string").parquet(f"{folder}/covers").collect()}

    def batches(self) -> list[str]:
        """Names of committed batches, folded ones too."""
        return sorted({*self._named("batch-"), *self._newest()[1]})

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch once; False if it was committed before, whatever `changes` holds now.

        `changes`: source, lang, version, op (insert, delete, revise), tokens (new count, or that of the deleted), old
        (count before a revision). Null keys are groups of their own, null counts are 0, other ops raise an error; repeated
        rows count each; no rows make a batch without effect; other columns are not read.
        """
        if batch in self.batches():
            return False
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
        sign = F.coalesce(sign, F.raise_error(F.lit("op must be insert, delete or revise")).cast("int"))
        new, old = F.coalesce(F.col("tokens"), F.lit(0)), F.coalesce(F.col("old"), F.lit(0))
        rows = changes.select(*KEYS, sign.alias("sign"), F.when(sign == 0, new - old).otherwise(sign * new).cast("long").alias("change"))
        delta = rows.groupBy(*KEYS).agg(F.sum(F.col("sign").cast("long")).alias("docs"), F.sum("change").alias("tokens"))
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        delta.write.parquet(staged)
        return self._renamed(staged, f"batch-{batch}")

    def _renamed(self, staged: str, name: str) -> bool:
        """Whether the staged folder is now the folder `name`; if that exists already, the staged one is removed."""
        source, done = self._path(staged), self._path(f"{self.path}/{name}")
        if not self._fs.exists(done) and self._fs.rename(source, done):
            nested = self._path(f"{self.path}/{name}/{source.getName()}")
            if not self._fs.exists(nested):
                return True
            self._fs.delete(nested, True)  # another writer's folder was there first, and some file systems move into it
            return False
        self._fs.delete(source, True)
        return False

    def _deltas(self) -> tuple[DataFrame | None, list[str]]:
        """All deltas that count, and the names of all batches in them."""
        fold, covered = self._newest()
        loose = [n for n in self._named("batch-") if n not in covered]
        folders = [f"{self.path}/batch-{n}" for n in loose] + ([f"{fold}/data"] if fold else [])
        return self.spark.read.schema(DELTA).parquet(*folders) if folders else None, sorted({*covered, *loose})

    @staticmethod
    def _summed(deltas: DataFrame) -> DataFrame:
        return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens; groups without documents and tokens are left out."""
        deltas, _ = self._deltas()
        return self.spark.createDataFrame([], DELTA) if deltas is None else self._summed(deltas)

    def compact(self) -> None:
        """Folds all committed batches and the fold before into a new fold; then removes what it covers.

        The fold appears by one rename. A stop before it leaves everything as it was, a stop after it leaves folders that the
        fold covers and that the next call removes. Names of covered batches stay known, so none is committed again.
        """
        deltas, names = self._deltas()
        if deltas is None:
            return
        folds = self._named("fold-")
        if [n for n in self._named("batch-") if n not in self._newest()[1]]:
            staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
            self._summed(deltas).write.parquet(f"{staged}/data")
            self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.parquet(f"{staged}/covers")
            number = int(folds[-1]) + 1 if folds else 0
            if not self._renamed(staged, f"fold-{number:012d}"):
                raise RuntimeError("another writer has compacted at the same time")
        self._clean()

    def _clean(self) -> None:
        fold, covered = self._newest()
        old = [f"batch-{n}" for n in self._named("batch-") if n in covered] + [f"fold-{n}" for n in self._named("fold-")[:-1]]
        for name in old if fold else []:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
