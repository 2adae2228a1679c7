"""Incremental captures: new products, and change-only prices, as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import empty_store, ingest
from ..schemas import CAPTURE

#: State is kept on disk beside the executors, not on their heaps.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "key string, price double, currency string, created timestamp, id long"


def capture_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Captures as they arrive in a folder."""
    return spark.readStream.schema(CAPTURE).option("recursiveFileLookup", True).json(folder, multiLine=True)


def product_stream(captures: DataFrame) -> DataFrame:
    """Products of a stream of captures that were never seen before; what was seen is kept in the checkpoint."""
    rows = captures.select("url", "captured_at", F.explode("products").alias("p")).select(F.col("url").alias("page_url"), "captured_at", "p.*")
    rows = rows.withColumn("__images", F.array_sort("images"))
    return rows.dropDuplicates(["name", "price_text", "price", "url", "__images", "currency"]).drop("__images")


def changed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's observations of a micro-batch, by time, against the last price kept in the state."""
    rows = pd.concat(frames).sort_values(["created", "id"], kind="stable")
    last = state.get if state.exists else None
    keep = []
    for price, currency in zip(rows["price"], rows["currency"], strict=True):
        keep.append((price, currency) != last)
        last = (price, currency)
    state.update(last)
    yield rows[keep][["key", "price", "currency", "created", "id"]]


def price_changes(observed: DataFrame) -> DataFrame:
    """The changes in a stream of (key, price, currency, created, id)."""
    return observed.groupBy("key").applyInPandasWithState(changed, CHANGE, "price double, currency string", "append", GroupStateTimeout.NoTimeout)


def start(stream: DataFrame, folder: str, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None, every: str | None = None) -> StreamingQuery:
    """Start a stream: with every (as "2 seconds") it polls on until stopped, else it ends when all that is there is done."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.foreachBatch(write).start() if write else writer.format("parquet").outputMode("append").start(folder)


def run_available(stream: DataFrame, folder: str, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process what is there and stop. With write, each micro-batch goes through it; else Parquet is appended to folder.

    A batch whose write failed is replayed whole from the checkpoint.
    """
    start(stream, folder, checkpoint, write).awaitTermination()


def into_store(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink of captures: each micro-batch is ingested into the tables under folder.

    A batch writes a version of its own, <folder>/v<batch>/<table>, from the one
    before; a replayed batch writes the same version again, so nothing is
    taken in twice. The last version is the store (see stored_tables()).
    """

    def write(captures: DataFrame, batch: int) -> None:
        spark = captures.sparkSession
        tables = stored_tables(spark, folder, batch) if batch else empty_store(spark)
        for name, table in ingest(tables, captures.select("url", "captured_at", "container", "products")).items():
            table.write.mode("overwrite").parquet(f"{folder}/v{batch}/{name}")

    return write


def stored_tables(spark: SparkSession, folder: str, before: int) -> dict[str, DataFrame]:
    """The tables as the batches before the given number left them."""
    return {name: spark.read.schema(table.schema).parquet(f"{folder}/v{before - 1}/{name}") for name, table in empty_store(spark).items()}


def stalls(polls: DataFrame, most: int = 3) -> DataFrame:
    """(url, captured_at, n_products, n_stalled, stopped) of polls (url, captured_at, n_products): how many in a row did not grow, and whether that is the end."""
    by_time = Window.partitionBy("url").orderBy("captured_at")
    before = F.max("n_products").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    rows = polls.withColumn("grew", F.coalesce(F.col("n_products") > before, F.lit(True)))
    rows = rows.withColumn("run", F.count_if("grew").over(by_time))
    stalled = (F.row_number().over(Window.partitionBy("url", "run").orderBy("captured_at")) - 1).alias("n_stalled")
    return rows.select("url", "captured_at", "n_products", stalled).withColumn("stopped", F.col("n_stalled") >= most)
