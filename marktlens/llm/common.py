"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_folder

#: A word everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, taken: list[str]) -> str:
    """name, with as many underscores before it as set it apart from the taken ones (whatever their case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def n_words(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share, removed when the session ends."""
    return fresh_folder(spark, what)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    It cuts the lineage like checkpoint(): what follows reads replicated
    files, whichever executors are lost meanwhile.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def free(*frames: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    for df in frames:
        drop_path(df.sparkSession, df.kept_at)


def join_small(left: DataFrame, right: DataFrame, key: str, how: str, most_bytes: int = 64 << 20, row_bytes: int = 16) -> DataFrame:
    """Join a side of few and short rows: broadcast if its counted size allows, else by shuffle."""
    small = right.count() * row_bytes <= most_bytes
    return left.join(F.broadcast(right) if small else right, key, how)
