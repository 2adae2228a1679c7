"""The product x provider price matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prices import display
from .scans import given


def latest_prices(prices: DataFrame) -> DataFrame:
    """(provider_product_id, price): the price recorded last; of equal times the one with the largest id."""
    return prices.groupBy("provider_product_id").agg(F.max_by("price", F.struct("created", "id")).alias("price"))


def cells(products: DataFrame, provider_products: DataFrame, latest: DataFrame) -> DataFrame:
    """(product_id, provider_id, price): the least current price; currencies are not compared."""
    listed = provider_products.where(given(F.col("product_id"))).select(F.col("id").alias("provider_product_id"), "product_id", "provider_id")
    found = listed.join(latest, "provider_product_id").groupBy("product_id", "provider_id").agg(F.min("price").alias("price"))
    return found.join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")


def rows(products: DataFrame, found: DataFrame, least_providers: int = 2) -> DataFrame:
    """(product_id, name, prices map, n_providers): products priced by enough providers; for display, see in_order()."""
    prices = F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider_id", "price"))))
    kept = found.groupBy("product_id").agg(prices.alias("prices"), F.count("*").alias("n_providers")).where(F.col("n_providers") >= least_providers)
    return kept.join(products.select(F.col("id").alias("product_id"), "name"), "product_id").select("product_id", "name", "prices", "n_providers")


def in_order(kept: DataFrame) -> DataFrame:
    """Rows or lines of the matrix in the order of its file: by lower-cased name."""
    return kept.orderBy(F.lower("name"), "product_id")


def long_rows(products: DataFrame, found: DataFrame, least_providers: int = 2) -> DataFrame:
    """(product_id, name, provider_id, price, n_providers): the cells of rows(), one a row, without gathering any."""
    kept = found.groupBy("product_id").agg(F.count("*").alias("n_providers")).where(F.col("n_providers") >= least_providers)
    return found.join(kept, "product_id").join(products.select(F.col("id").alias("product_id"), "name"), "product_id").select("product_id", "name", "provider_id", "price", "n_providers")


def columns(providers: DataFrame, kept: DataFrame) -> DataFrame:
    """(provider_id, domain, n_cells, position): all providers, those with most priced cells first, then by domain.

    kept: what rows() or long_rows() returns. All providers are ranked in one
    task, one row each: they are the columns of one file.
    """
    cells_of = kept if "provider_id" in kept.columns else kept.select(F.explode(F.map_keys("prices")).alias("provider_id"))
    counts = cells_of.groupBy("provider_id").agg(F.count("*").alias("n_cells"))
    each = providers.select(F.col("id").alias("provider_id"), "domain").join(counts, "provider_id", "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))
    return each.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n_cells"), "domain", "provider_id")))


def csv_lines(kept: DataFrame, order: DataFrame) -> DataFrame:
    """(product_id, name, line): a line of the matrix's CSV for each row; blank cells for missing prices.

    order: what columns() returns. A price finds its column by a join; a line
    is its prices in order of column and as many commas before each as columns
    were passed, so a wide matrix costs little more than its bytes. Only then
    are there long lines, which nothing shuffles any more.
    """
    place = order.select("provider_id", "position")
    cells = kept.select("product_id", F.explode("prices").alias("provider_id", "price")).distinct().join(place, "provider_id")
    cells = cells.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("position", F.coalesce(display(F.col("price")), F.lit("")).alias("text")))).alias("cells"))
    rows = kept.select("product_id", "name").join(cells, "product_id", "left").crossJoin(F.broadcast(order.agg(F.count("*").cast("int").alias("width"))))
    before = lambda i: F.when(i > 0, F.get("cells", i - 1)["position"]).otherwise(F.lit(0))
    pieces = F.transform("cells", lambda c, i: F.concat(F.repeat(F.lit(","), c["position"] - before(i)), c["text"]))
    last = F.coalesce(F.element_at("cells", -1)["position"], F.lit(0))
    quoted = F.when(F.col("name").rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace("name", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("name"))
    parts = F.concat(F.array(quoted), F.coalesce(pieces, F.array().cast("array<string>")), F.array(F.repeat(F.lit(","), F.col("width") - last)))
    line = F.array_join(parts, "")
    return rows.select("product_id", "name", F.when(F.col("name").isNull(), F.substr(line, F.lit(2))).otherwise(line).alias("line"))


def json_lines(kept: DataFrame) -> DataFrame:
    """(product_id, name, json): each row of the matrix as a JSON object, its prices in order of provider."""
    prices = F.transform(F.array_sort(F.map_keys("prices")), lambda p: F.struct(p.alias("provider_id"), F.element_at("prices", p).alias("price")))
    return kept.select("product_id", "name", F.to_json(F.struct("product_id", "name", prices.alias("prices"))).alias("json"))


def cheapest(found: DataFrame) -> DataFrame:
    """(product_id, provider_id, price, place): providers of each product from the cheapest; equal prices share a place."""
    return found.withColumn("place", F.rank().over(Window.partitionBy("product_id").orderBy("price")))
