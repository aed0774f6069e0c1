"""Tables between steps, in the folder that the cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one with a local master, and an error on a cluster, whose machines don't share a local folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tapeloom-"))
    return sc.getCheckpointDir()


def place(spark: SparkSession, name: str) -> str:
    """A new folder of that name."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """The same rows, worked out once: a reliable checkpoint, which is read however often they are used."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)
