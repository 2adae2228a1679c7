"""Writes to the store as DataFrame transformations: a table and a batch give the table's next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_ends


def new_id(*key: Column) -> Column:
    """A reproducible id of a record's key, so that a retried batch writes the same rows."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]), 256), 1, 15)


def first_of(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first in order."""
    return batch.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def insert_new(table: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The table and those rows of the batch whose key it lacks (the first of each key); stored rows win."""
    fresh = first_of(batch, keys, order or sorted(batch.columns))
    on = [table[k].eqNullSafe(fresh[k]) for k in keys]
    return table.unionByName(fresh.join(table, on, "left_anti"), allowMissingColumns=True)


def ensure_providers(providers: DataFrame, hosts: DataFrame) -> DataFrame:
    """providers with a row for each new host."""
    fresh = hosts.select(F.col("host").alias("domain")).where("domain <> ''").distinct()
    fresh = fresh.select(new_id(F.col("domain")).alias("id"), "domain", F.col("domain").alias("name"), F.lit(True).alias("enabled"), F.lit(None).cast("string").alias("default_currency"))
    return insert_new(providers, fresh, ["domain"])


def upsert_listings(provider_products: DataFrame, seen: DataFrame) -> DataFrame:
    """seen (provider_id, name, url, seen_at) with the listing's id and whether it is new, by (provider_id, name).

    The name decides alone: a known name keeps its listing whatever its url is.
    """
    known = provider_products.select("provider_id", "name", F.col("id").alias("known"))
    rows = first_of(seen, ["provider_id", "name"], ["seen_at", "url"]).join(known, ["provider_id", "name"], "left")
    return rows.select("provider_id", "name", "url", "seen_at", F.coalesce("known", new_id(F.col("provider_id"), F.col("name"))).alias("id"), F.col("known").isNull().alias("is_new"))


def sync_images(stored: DataFrame, cards: DataFrame) -> DataFrame:
    """The image changes that bring stored images to what the cards show.

    cards: provider_product_id, images (in order). Returns provider_product_id,
    url, position, is_primary and action: insert, update, keep or delete. Only
    the cards' listings are touched; the first image is the primary one.
    """
    now = cards.select("provider_product_id", F.posexplode("images").alias("position", "url")).where("url <> ''")
    now = first_of(now, ["provider_product_id", "url"], ["position"]).withColumn("position", F.col("position").cast("long")).withColumn("is_primary", F.col("position") == 0)
    touched = stored.join(cards.select("provider_product_id").distinct(), "provider_product_id", "left_semi")
    old = touched.select("provider_product_id", "url", F.col("position").alias("was"), F.col("is_primary").alias("was_primary"), F.lit(True).alias("there"))
    both = now.withColumn("here", F.lit(True)).join(old, ["provider_product_id", "url"], "full_outer")
    same = (F.col("position") == F.col("was")) & (F.col("is_primary") == F.col("was_primary"))
    action = F.when(F.col("here").isNull(), "delete").when(F.col("there").isNull(), "insert").when(same, "keep").otherwise("update")
    return both.select("provider_product_id", "url", F.coalesce("position", "was").alias("position"), F.coalesce("is_primary", "was_primary").alias("is_primary"), action.alias("action"))


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The listing tables without the listings of gone (a column id) and all that hangs on them."""
    out = {}
    for name, table in tables.items():
        key = "id" if name == "provider_products" else "provider_product_id"
        out[name] = table.join(gone.select(F.col("id").alias(key)), key, "left_anti").select(*table.columns)
    return out


def delete_unbranded(tables: dict[str, DataFrame], brands: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """The listing tables without the listings that no known brand covers, and without all that hangs on them."""
    from .brands import unbranded

    return cascade_delete(tables, unbranded(tables["provider_products"], brands, products).select("id"))


def delta(products: DataFrame, seen: DataFrame | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Products not seen before, each once: equal in name, price, text, url, currency and set of images."""
    keyed = products.withColumn("__images", F.array_sort("images"))
    fields = ["name", "price_text", "price", "url", "__images", "currency"]
    if order:
        keyed = first_of(keyed, fields, list(order))
    else:
        keyed = keyed.dropDuplicates(fields)
    if seen is not None:
        old = seen.withColumn("__images", F.array_sort("images"))
        keyed = keyed.join(old, [keyed[f].eqNullSafe(old[f]) for f in fields], "left_anti")
    return keyed.drop("__images")


def best_grid(polls: DataFrame) -> DataFrame:
    """(url, products): of each page's polls the one with the most products, the earliest of equals."""
    rank = F.struct(F.size("products").alias("n"), (-F.col("captured_at")).alias("first"))
    return polls.groupBy("url").agg(F.max_by("products", rank).alias("products"))


def trimmed_products(rows: DataFrame) -> DataFrame:
    """Catalog rows (brand, product_name, size) trimmed, without nameless ones."""
    return rows.select(*[F.coalesce(collapse_ends(F.col(c)), F.lit("")).alias(c) for c in ("brand", "product_name", "size")]).where("product_name <> ''")
