"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "tapeline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` overrides them (dots as written in Spark's keys)."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | conf)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset (local runs, tests) one of our own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tapeline-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder: later jobs read it, and it survives a lost executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
