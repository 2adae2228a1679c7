"""Captures into the store: providers, scrapes, listings, images and change-only prices, as one step that can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import currency_of
from ..functions.urls import host_of
from ..schemas import TABLES
from .history import changes, last_per_scrape
from .store import ensure_providers, first_of, insert_new, new_id, sync_images, upsert_listings


def insert_scrapes(scrapes: DataFrame, captures: DataFrame) -> DataFrame:
    """scrapes with a row for each capture (provider_id, url, captured_at, container, products)."""
    fresh = captures.select(
        new_id(F.col("url"), F.col("captured_at")).alias("id"), "provider_id", "url", F.timestamp_seconds("captured_at").alias("scraped_at"), F.lit("success").alias("status"),
        F.lit(None).cast("string").alias("capture_path"), F.size("products").cast("long").alias("product_count"), F.coalesce(F.get("container.classes", F.lit(0)), F.lit("")).alias("container_class"),
    )
    return insert_new(scrapes, fresh, ["id"])


def insert_prices(prices: DataFrame, observed: DataFrame) -> DataFrame:
    """prices with those of observed (same columns) that differ from what was recorded before, per listing in time.

    Of several observations of a listing in one scrape the last counts. What
    is stored already takes part as history, so a repeated batch adds nothing.
    """
    columns = prices.columns
    touched = prices.join(observed.select("provider_product_id").distinct(), "provider_product_id", "left_semi").withColumn("__stored", F.lit(True))
    fresh = last_per_scrape(observed).join(prices, ["provider_product_id", "scrape_id"], "left_anti").withColumn("__stored", F.lit(False))
    every = changes(touched.unionByName(fresh, allowMissingColumns=True)).where("not __stored")
    return prices.unionByName(every.select(*columns))


def insert_matches(matches: DataFrame, edges: DataFrame) -> DataFrame:
    """matches with new pairs (provider_product_id, product_id, score) as pending ones; a stored pair keeps its score and status."""
    fresh = edges.select(new_id(F.col("provider_product_id"), F.col("product_id")).alias("id"), "provider_product_id", "product_id", "score", F.lit("pending").alias("status"))
    return insert_new(matches, fresh, ["provider_product_id", "product_id"])


def apply_images(images: DataFrame, changed: DataFrame) -> DataFrame:
    """images after the changes of sync_images()."""
    gone = changed.select("provider_product_id", "url")
    now = changed.where("action <> 'delete'").select(new_id(F.col("provider_product_id"), F.col("url")).alias("id"), "provider_product_id", "url", "position", "is_primary")
    return images.join(gone, ["provider_product_id", "url"], "left_anti").select(*images.columns).unionByName(now)


def ingest(tables: dict[str, DataFrame], captures: DataFrame) -> dict[str, DataFrame]:
    """The store's tables after captures (url, captured_at, container, products) were taken in.

    tables: providers, scrapes, provider_products, provider_product_images and
    provider_product_prices. Ids are hashes of keys, stored rows win and prices
    are compared with the history, so the same captures again change nothing.
    Captures whose url has no host, and nameless products, are left out; a
    product's currency falls back to its provider's.
    """
    captures = captures.withColumn("domain", host_of(F.col("url"))).where("domain <> ''")
    providers = ensure_providers(tables["providers"], captures.select(F.col("domain").alias("host")))
    known = providers.select(F.col("id").alias("provider_id"), "domain", "default_currency")
    captures = captures.join(known, "domain")
    scrapes = insert_scrapes(tables["scrapes"], captures)
    cards = captures.select("provider_id", "default_currency", "captured_at", new_id(F.col("url"), F.col("captured_at")).alias("scrape_id"), F.posexplode("products").alias("position", "p"))
    cards = cards.select("provider_id", "default_currency", "captured_at", "scrape_id", "position", "p.*").where("name <> ''")
    seen = cards.select("provider_id", "name", F.coalesce("url", F.lit("")).alias("url"), F.timestamp_seconds("captured_at").alias("seen_at"))
    found = upsert_listings(tables["provider_products"], seen)
    fresh = found.where("is_new").select("id", "provider_id", "name", F.col("url").alias("provider_product_url"), *empty("product_id", "brand_id"), F.col("seen_at").alias("last_seen_at"))
    listings = tables["provider_products"].unionByName(fresh)
    cards = cards.join(found.select("provider_id", "name", F.col("id").alias("provider_product_id")), ["provider_id", "name"])
    last = first_of(cards.withColumn("__back", -F.col("captured_at")).withColumn("__place", -F.col("position")), ["provider_product_id"], ["__back", "__place"])
    images = apply_images(tables["provider_product_images"], sync_images(tables["provider_product_images"], last.select("provider_product_id", "images")))
    observed = cards.select(
        F.concat_ws("-", "scrape_id", F.lpad(F.col("position").cast("string"), 9, "0")).alias("id"), "provider_product_id", "scrape_id", "price", currency_of(F.col("currency"), F.col("default_currency")).alias("currency"),
        "price_text", F.timestamp_seconds("captured_at").alias("created"),
    )
    prices = insert_prices(tables["provider_product_prices"], observed)
    return {"providers": providers, "scrapes": scrapes, "provider_products": listings, "provider_product_images": images, "provider_product_prices": prices}


def empty(*names: str) -> list[Column]:
    return [F.lit(None).cast("string").alias(n) for n in names]


def empty_store(spark) -> dict[str, DataFrame]:
    """The tables that ingest() writes, without rows."""
    names = ("providers", "scrapes", "provider_products", "provider_product_images", "provider_product_prices")
    return {n: spark.createDataFrame([], TABLES[n]) for n in names}
