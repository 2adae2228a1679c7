"""The engine's domain tables as projections of the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("domain"))


def catalog_name() -> Column:
    return F.concat_ws(" ", "p_brand", "p_name", F.col("p_size").cast("string"), F.lit("ml"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), catalog_name().alias("name"), F.col("p_brand").alias("brand"), F.col("p_name").alias("product_name"),
        F.concat(F.col("p_size").cast("string"), F.lit(" ml")).alias("size"), (F.col("p_partkey") % 10 != 9).alias("active"),
    )


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three in four of the brands that parts have."""
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    return source(spark, sf_dir, "part").select(F.concat(F.lit("b-"), F.col("p_brand")).alias("id"), F.col("p_brand").alias("name"), number.alias("n")).where(F.coalesce(F.col("n") % 4, F.lit(1)) != 0).drop("n").distinct()


def provider_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing for each part and supplier that ever met; one in four is not linked, one in three names lacks the brand."""
    pairs = source(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct().join(source(spark, sf_dir, "part"), "p_partkey")
    bare = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("ml"))
    return pairs.select(
        F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("p_partkey").cast("string")).alias("id"), F.col("l_suppkey").cast("string").alias("provider_id"),
        F.when(F.col("l_suppkey") % 3 == 0, bare).otherwise(catalog_name()).alias("name"),
        F.when((F.col("p_partkey") + F.col("l_suppkey")) % 4 != 0, F.col("p_partkey").cast("string")).alias("product_id"),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("b-"), F.col("p_brand"))).alias("brand_id"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("provider_product_id"),
        (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100).alias("price"), F.col("l_shipdate").alias("created"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that repeat: the events of a user and type, in steps of 50."""
    return source(spark, sf_dir, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("provider_product_id"), F.floor(F.col("value") / 50).cast("double").alias("price"),
        F.lit(None).cast("string").alias("currency"), F.col("ts").alias("created"), F.col("event_id").alias("id"),
    )


def catalog_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of each part at one of 20 providers, its name in another order of words."""
    return source(spark, sf_dir, "part").select(
        F.concat(F.lit("l-"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_partkey") % 20).cast("string").alias("provider_id"),
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("ml -"), "p_brand").alias("name"),
    )


SQL = """
providers AS (SELECT s_suppkey::VARCHAR AS id, s_name AS domain FROM supplier),
products AS (SELECT p_partkey::VARCHAR AS id, concat_ws(' ', p_brand, p_name, p_size::VARCHAR, 'ml') AS name, p_brand AS brand, p_name AS product_name, p_size || ' ml' AS size, p_partkey % 10 <> 9 AS active FROM part),
brand AS (SELECT DISTINCT 'b-' || p_brand AS id, p_brand AS name FROM part WHERE coalesce(try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 4, 1) <> 0),
provider_products AS (
  SELECT l_suppkey || '-' || p_partkey AS id, l_suppkey::VARCHAR AS provider_id,
         CASE WHEN l_suppkey % 3 = 0 THEN concat_ws(' ', p_name, p_size::VARCHAR, 'ml') ELSE concat_ws(' ', p_brand, p_name, p_size::VARCHAR, 'ml') END AS name,
         CASE WHEN (p_partkey + l_suppkey) % 4 <> 0 THEN p_partkey::VARCHAR END AS product_id, CASE WHEN l_suppkey % 2 = 0 THEN 'b-' || p_brand END AS brand_id
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey),
prices AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey || '-' || l_partkey AS provider_product_id, floor(l_extendedprice * 100 / l_quantity) / 100 AS price, l_shipdate AS created FROM lineitem),
observations AS (SELECT user_id || '/' || event_type AS provider_product_id, floor(value / 50)::DOUBLE AS price, ts AS created, event_id AS id FROM events),
latest AS (SELECT provider_product_id, arg_max(price, (created, id)) AS price FROM prices GROUP BY 1),
cells AS (SELECT product_id, provider_id, min(price) AS price FROM provider_products v JOIN latest l ON l.provider_product_id = v.id WHERE product_id IS NOT NULL GROUP BY ALL),
kept AS (SELECT product_id, provider_id, price, count(*) OVER (PARTITION BY product_id) AS n_providers FROM cells QUALIFY n_providers >= 2),
tok AS (SELECT DISTINCT name, list_filter(string_split_regex(lower(name), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS t FROM provider_products),
btok AS (SELECT id, name, list_filter(string_split_regex(lower(name), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS t FROM brand),
best AS (SELECT tok.name, arg_max(struct_pack(id := btok.id, brand := btok.name), (strlen(btok.name), btok.name, btok.id)) AS b FROM tok JOIN btok ON list_has_all(tok.t, btok.t) GROUP BY 1)
"""
