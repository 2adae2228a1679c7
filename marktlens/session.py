"""A Spark session with the settings the engine is written for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution splits skewed joins and sizes shuffles at run time; timestamps are UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """The running session, or a new one. Settings override ours; a cluster's own master is left alone."""
    builder = SparkSession.builder.appName("marktlens").config(map=SETTINGS | settings)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in tests, may do without it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/checkpoints/{sc.applicationId}"
        sc.setCheckpointDir(found)
    return found


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the session ends."""
    path = f"{shared_folder(spark)}/marktlens/{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df written once in the shared folder and read back, so that several uses don't compute it again."""
    path = fresh_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
