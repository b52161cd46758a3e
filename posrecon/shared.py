"""The folder that the driver and all executors of a session share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder for its lifetime; on a
    cluster, where executors have disks of their own, a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        found = context._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if not named:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="posrecon-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/posrecon-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table once below the shared folder and read it back.

    The plan ends there: what uses the table several times does not compute it again, and a
    lost executor costs a re-read.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
