"""What the corpus operators share: scratch tables in the shared folder, word patterns, text defaults."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than one in HOT of all rows is dealt to SALTS tasks; there are fewer than HOT such keys.
HOT, SALTS = 1000, 64


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or the session's checkpoint folder.

    Only a local session that names neither (a test) gets a temporary folder of its own; any other must name one.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors.

    The table is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files of a table made by `stored` that nothing will read again."""
    spark = df.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def salted_join(rows: DataFrame, keys: DataFrame, on: list[str], spread: Column, how: str = "inner", hot: int = HOT) -> DataFrame:
    """`rows` joined (inner or left) with `keys`, hot keys of the rows dealt to SALTS tasks by `spread`, an integer of the row.

    Both are read more than once, so they are tables or cheap to make. The hot keys are broadcast: a key is hot if it has more than
    one in `hot` of all rows, so there are fewer than `hot`. Null keys match nothing and are hot like others.
    """
    counts = rows.groupBy(*on).agg(F.count("*").alias("_n"))
    total = rows.count()
    few = F.broadcast(counts.where(F.col("_n") * hot > total).select(*(F.col(c).alias(f"_{c}") for c in on), F.lit(True).alias("_hot")))
    same = lambda side: reduce(lambda a, b: a & b, (side[c].eqNullSafe(few[f"_{c}"]) for c in on))
    left = rows.join(few, same(rows), "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(0)).select(*rows.columns, "_salt")
    each = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    right = keys.join(few, same(keys), "left").select(*keys.columns, each.alias("_salt"))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def text_of(column: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
