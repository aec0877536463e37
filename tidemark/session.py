"""Session defaults."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: UTC everywhere, adaptive plans, Arrow for what Python there is.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Lets checkpoint() write: to spark.checkpoint.dir, or to what the session names; a session in one process gets a folder of its own."""
    context = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
    elif context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
