"""Steps of work whose tables are committed once: a rerun finds a step whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Commits:
    """Tables of numbered or named steps below a folder that all executors share.

    A step's tables are written to a folder of their own, which is then renamed to the step's name; a stop before that leaves a
    folder that nothing reads, and a step that is there already stays as it is. One driver commits at a time.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def done(self, step: int | str) -> bool:
        files, path = self._path(f"step={step}")
        return files.exists(path)

    def write(self, step: int | str, tables: dict[str, DataFrame]) -> bool:
        """Commits the tables; False, without computing any, if the step is there."""
        if self.done(step):
            return False
        attempt = f"_attempt-{uuid.uuid4().hex}"
        for name, table in tables.items():
            table.write.parquet(f"{self.root}/{attempt}/{name}")
        files, source = self._path(attempt)
        _, target = self._path(f"step={step}")
        if not files.rename(source, target):
            raise OSError(f"step {step} could not be committed below {self.root}")
        return True

    def read(self, step: int | str, name: str, schema: StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/step={step}/{name}")

    def read_all(self, name: str, schema: str) -> DataFrame:
        """The table of all steps, with `step`; empty before there is any."""
        files, path = self._path("")
        if not files.exists(path) or not files.globStatus(self._path("step=*")[1]):
            return self.spark.createDataFrame([], f"{schema}, step string")
        return self.spark.read.schema(f"{schema}, step string").option("basePath", self.root).parquet(f"{self.root}/step=*/{name}")
