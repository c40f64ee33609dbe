"""The folder that driver and executors share, and checkpoints in it."""

from __future__ import annotations

import os
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; its own only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "marlstone-checkpoints"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder (never a local checkpoint: executors may be lost)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def tidied(spark: SparkSession, seconds: float = 10) -> Iterator[None]:
    """Meanwhile the driver collects its garbage every few seconds: Spark removes shuffle files only when the
    driver has forgotten the shuffle."""
    over = threading.Event()

    def run():
        while not over.wait(seconds):
            spark.sparkContext._jvm.System.gc()

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
