"""Cutting lineage between rounds of an iteration."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether a frame deletes its shuffle files when it has run.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where none is set, a local session (one machine, as in tests) gets one of its own; a cluster's executors don't
    share such a folder, so there it is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvane-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder and read from there."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spent(df: DataFrame) -> DataFrame:
    """kept(df); the files that df shuffled are deleted as soon as it is written, not when the driver collects its garbage.

    A frame is told so as it is made, so this is a new one, which runs once.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANED, "false")
    conf.set(CLEANED, "true")
    try:
        once = df.select("*")
    finally:
        conf.set(CLEANED, before)
    return kept(once)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the files of checkpoints and shuffles that nothing refers to any more, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession) -> str:
    """A new path below the checkpoint folder, for what a query writes and reads again."""
    return f"{folder(spark)}/{uuid.uuid4().hex}"
