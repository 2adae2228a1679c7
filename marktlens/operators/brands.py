"""Brand assignment and brand gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .scans import given


def covered(names: DataFrame, brands: DataFrame, name: str = "name", brand: str = "name", keep: tuple[str, ...] = ()) -> DataFrame:
    """(name, brand, and the brand rows' columns keep) where every word of the brand is in the name.

    Both sides are made distinct, and meet on the brand's rarest word over
    the brands (only then are all words compared), so the nested loop of all
    names and brands never runs. A brand without words covers names without
    words alone.
    """
    texts = names.select(F.col(name).alias("n")).distinct().withColumn("nt", tokens(F.col("n")))
    labels = brands.select(F.col(brand).alias("b"), *keep).distinct().withColumn("bt", F.array_distinct(tokens(F.col("b"))))
    words = labels.select(F.explode("bt").alias("word")).groupBy("word").agg(F.count("*").alias("n_brands"))
    rarest = labels.select("b", F.explode("bt").alias("word")).distinct().join(words, "word").groupBy("b").agg(F.min(F.struct("n_brands", "word")).alias("r")).select("b", F.col("r.word").alias("word"))
    keyed = labels.join(rarest, "b", "left").withColumn("word", F.coalesce("word", F.lit("")))
    by_word = texts.withColumn("word", F.explode(F.when(F.size("nt") > 0, F.array_distinct("nt")).otherwise(F.array(F.lit("")))))
    fits = F.size(F.array_except("bt", "nt")) == 0
    return by_word.join(keyed, "word").where(fits).select(F.col("n").alias("name"), F.col("b").alias("brand"), *keep)


def best_brand(names: DataFrame, brands: DataFrame) -> DataFrame:
    """(name, brand_id, brand): of the brands that cover a name the longest in bytes, then the last by (name, id)."""
    found = covered(names, brands.select(F.col("id").alias("brand_id"), "name"), keep=("brand_id",))
    best = F.max_by(F.struct("brand_id", "brand"), F.struct(F.octet_length("brand"), "brand", "brand_id"))
    return found.groupBy("name").agg(best.alias("best")).select("name", "best.brand_id", "best.brand")


def assign(provider_products: DataFrame, products: DataFrame, brands: DataFrame) -> DataFrame:
    """(id, current, target, via, changed) of every listing.

    A linked listing takes its active product's brand, null if product or
    brand is unknown; an unlinked one the best covering brand.
    """
    owned = products.where("active").select(F.col("id").alias("product_id"), F.trim("brand").alias("owned"))
    ids = brands.groupBy(F.col("name").alias("owned")).agg(F.max("id").alias("owned_id"))
    linked = given(F.col("product_id"))
    rows = provider_products.join(owned, "product_id", "left").join(ids, "owned", "left")
    rows = rows.join(best_brand(provider_products.where(~linked), brands).select("name", F.col("brand_id").alias("fuzzy_id")), "name", "left")
    current = F.when(given(F.col("brand_id")), F.col("brand_id"))
    target = F.when(linked, F.col("owned_id")).otherwise(F.col("fuzzy_id"))
    via = F.when(target.isNull(), "unmatched").when(linked, "product").otherwise("fuzzy")
    return rows.select("id", current.alias("current"), target.alias("target"), via.alias("via"), (~current.eqNullSafe(target)).alias("changed"))


def summary(assigned: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(c).cast("long")
    return assigned.agg(*[count(F.col("via") == v).alias(f"n_{v}") for v in ("product", "fuzzy", "unmatched")], count(F.col("changed")).alias("n_updated"))


def missing(provider_products: DataFrame, products: DataFrame, providers: DataFrame, coverage: Column) -> DataFrame:
    """(id, domain, name, brand) of linked listings whose name lacks a word of their product's brand."""
    owned = products.where(F.trim("brand") != "").select(F.col("id").alias("product_id"), "brand")
    domains = providers.select(F.col("id").alias("provider_id"), "domain")
    rows = provider_products.where(given(F.col("product_id"))).join(owned, "product_id").where(coverage < 1.0).join(domains, "provider_id", "left")
    return rows.select("id", F.coalesce("domain", F.lit("")).alias("domain"), "name", "brand")


def known_brands(brands: DataFrame, products: DataFrame) -> DataFrame:
    """The distinct trimmed non-empty names of the brand table and of products."""
    return brands.select(F.trim("name").alias("name")).unionByName(products.select(F.trim("brand").alias("name"))).where("name <> ''").distinct()


def unbranded(provider_products: DataFrame, brands: DataFrame, products: DataFrame) -> DataFrame:
    """Listings that no known brand covers; none if no brand is known."""
    known = known_brands(brands, products)
    rest = provider_products.join(covered(provider_products, known).select("name").distinct(), "name", "left_anti")
    return rest.join(F.broadcast(known.limit(1).select(F.lit(1).alias("one"))), how="left_semi").select(*provider_products.columns)


def proposals(provider_products: DataFrame, products: DataFrame, brands: DataFrame) -> DataFrame:
    """Catalog rows proposed from unlinked listings; of equal ones that of the smallest listing id."""
    from ..functions.text import ascii_lower, collapse, collapse_ends, full_name, split_size, strip_brand

    rows = provider_products.where(~given(F.col("product_id"))).select(F.col("id").alias("provider_product_id"), collapse_ends(F.col("name")).alias("name")).where("name <> ''")
    rows = rows.join(best_brand(rows, brands).select("name", F.col("brand").alias("b")), "name", "left").withColumn("b", F.coalesce("b", F.lit("")))
    rows = rows.withColumn("plain", F.when(F.col("b") == "", F.col("name")).otherwise(strip_brand(F.col("name"), F.col("b"))))
    rows = rows.withColumn("s", split_size(F.col("plain")))
    rows = rows.select("provider_product_id", F.col("name").alias("source_name"), collapse_ends(F.col("b")).alias("brand"), collapse_ends(F.col("s.name")).alias("product_name"), F.coalesce("s.size", F.lit("")).alias("size"))
    rows = rows.where("product_name <> ''").withColumn("name", full_name(F.col("brand"), F.col("product_name"), F.col("size")))
    there = products.select(ascii_lower(collapse(F.col("name"))).alias("__name")).distinct()
    rows = rows.withColumn("__name", ascii_lower(F.col("name"))).join(there, "__name", "left_anti").drop("__name")
    first = Window.partitionBy(*[ascii_lower(F.col(c)) for c in ("brand", "product_name", "size")]).orderBy("provider_product_id")
    return rows.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
