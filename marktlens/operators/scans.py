"""Filters and projections over the store's tables; Catalyst pushes them into the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH_SCORE, BRAND_SCORE = 0.6, 1.0


def given(x: Column) -> Column:
    """Is a relation set? Unset ones are null or empty."""
    return F.coalesce(x != "", F.lit(False))


def active_products(products: DataFrame) -> DataFrame:
    return products.where("active")


def of_provider(provider_products: DataFrame, provider_id: str) -> DataFrame:
    return provider_products.where(F.col("provider_id") == provider_id)


def related_ids(table: DataFrame, provider_product_id: str) -> DataFrame:
    return table.where(F.col("provider_product_id") == provider_product_id).select("id")


def above_threshold(matches: DataFrame) -> DataFrame:
    """(provider_product_id, product_id, score) of stored matches that count."""
    return matches.where(F.col("score") >= MATCH_SCORE).select("provider_product_id", "product_id", "score")


def stored_for(matches: DataFrame, provider_products: DataFrame) -> DataFrame:
    """All stored matches of the given listings."""
    return matches.join(provider_products.select(F.col("id").alias("provider_product_id")), "provider_product_id", "left_semi")
