"""Change-only price history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_per_scrape(observed: DataFrame) -> DataFrame:
    """Of several observations of a listing in one scrape, the last one."""
    rest = [c for c in observed.columns if c not in ("provider_product_id", "scrape_id")]
    last = F.max_by(F.struct(*rest), F.struct("created", "id"))
    return observed.groupBy("provider_product_id", "scrape_id").agg(last.alias("o")).select("provider_product_id", "scrape_id", "o.*")


def changes(observed: DataFrame, keys: tuple[str, ...] = ("provider_product_id",), values: tuple[str, ...] = ("price", "currency"), order: tuple[str, ...] = ("created", "id")) -> DataFrame:
    """The observations whose values differ from the one before, per key in order; the first always counts."""
    now = F.struct(*values)
    before = F.lag(now).over(Window.partitionBy(*keys).orderBy(*order))
    return observed.withColumn("__before", before).where(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(now)).drop("__before")


def summary(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """One row: observations, changes stored, and listings."""
    return observed.agg(F.count("*").alias("n_observed"), F.countDistinct("provider_product_id").alias("n_listings")).join(F.broadcast(stored.agg(F.count("*").alias("n_stored"))))
