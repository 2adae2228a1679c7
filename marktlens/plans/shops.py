"""Shop pages rendered from the part table in five layouts, with the answer that a detector must give, in SQL.

Twelve parts a page; a page's layout is its number modulo five. All markup is
built by column expressions. Pages are what the detection, capture and ingest
queries run over, since the driver's own pages hold articles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .domain import source

PER_PAGE = 12


def fmt(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def layouts() -> list[Column]:
    """A card in each layout, from key, name, p_name, p_brand, p_size, us (1,234.56) and eu (1.234,56)."""
    key, name, us, eu = F.col("key"), F.col("name"), F.col("us"), F.col("eu")
    return [
        fmt('<div class="card"><a href="/p/', key, '" title="', name, '">', name, '</a><img src="/i/', key, '.jpg"><div class="price">$ ', us, "</div></div>"),
        fmt('<li><h2><a href="/l/', key, '">', name, "</a></h2><div>€ ", eu, "</div></li>"),
        fmt('<div class="card"><img alt="', name, '" src="/i/', key, '.png"><div><span class="x-product-price">', F.substring_index(eu, ",", 1), '</span><span class="x-product-price">,', F.substring_index(eu, ",", -1), "</span></div></div>"),
        fmt('<div class="card"><a title="', name, '" href="/q/', key, '"></a><div class="prices"><div>£ 99,999.99</div><div><span itemprop="price">£ ', us, "</span></div></div></div>"),
        fmt('<div class="card"><span class="productBrandName">', F.col("p_brand"), '</span><a href="#"></a><a href="/r/', key, '" title="', F.col("p_name"), " ", key, '">more</a><span class="skuSelectorItem">5 ml</span><span class="skuSelectorItem selected">', F.col("p_size"), ' ml</span><img src="/a.png"><img src="/b.png"><img src="/a.png"><div class="price">AR$ ', us, "</div></div>"),
    ]


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): all parts, in order of their keys."""
    us = F.format_number(F.col("p_retailprice"), 2)
    part = source(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), "p_name", "p_brand", "p_size", us.alias("us"), F.translate(us, ",.", ".,").alias("eu"),
        F.expr(f"p_partkey div {PER_PAGE}").alias("page_id"), F.concat_ws(" ", "p_brand", "p_name", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.lit("ml")).alias("name"),
    )
    layout = F.col("page_id") % len(layouts())
    card = reduce(lambda later, nc: F.when(layout == nc[0], nc[1]).otherwise(later), list(enumerate(layouts()))[:-1], layouts()[-1])
    pages = part.select("page_id", F.struct("key", card.alias("card")).alias("c")).groupBy("page_id").agg(F.array_sort(F.collect_list("c")).alias("cards"))
    cards = F.array_join(F.transform("cards", lambda c: c["card"]), "")
    grid = F.when(layout == 1, fmt("<ul>", cards, "</ul>")).otherwise(cards)
    html = fmt('<!DOCTYPE html><html><body><div class="page"><div class="top">Shop</div><div class="goods list', layout, '" id="g', F.col("page_id"), '">', grid, '</div><div class="foot">Contact</div></div></body></html>')
    return pages.select("page_id", fmt("https://shop", layout, ".test/c?page=", F.col("page_id")).alias("url"), html.alias("html"))


#: What stands on the pages: (page_id, layout, position, name, price_text, price, url, currency, images).
SQL = f"""
shown AS (
  SELECT p_partkey // {PER_PAGE} AS page_id, (p_partkey // {PER_PAGE}) % 5 AS layout, row_number() OVER (PARTITION BY p_partkey // {PER_PAGE} ORDER BY p_partkey) - 1 AS position,
         p_partkey AS key, concat_ws(' ', p_brand, p_name, p_partkey::VARCHAR, p_size::VARCHAR, 'ml') AS name, p_retailprice::DECIMAL(12,2) AS amount, format('{{:,.2f}}', p_retailprice) AS us, count(*) OVER (PARTITION BY p_partkey // {PER_PAGE}) AS n
  FROM part),
grids AS (
  SELECT page_id, layout, n, 'https://shop' || layout || '.test/c?page=' || page_id AS page_url, position::INTEGER AS position, name, amount::DOUBLE AS price,
         CASE WHEN layout IN (1, 2) THEN translate(us, ',.', '.,') ELSE us END AS price_text,
         CASE layout WHEN 0 THEN '/p/' || key WHEN 1 THEN '/l/' || key WHEN 3 THEN '/q/' || key WHEN 4 THEN '/r/' || key END AS url,
         CASE layout WHEN 1 THEN 'EUR' WHEN 3 THEN 'GBP' WHEN 4 THEN 'ARS' END AS currency,
         CASE layout WHEN 0 THEN ['/i/' || key || '.jpg'] WHEN 2 THEN ['/i/' || key || '.png'] WHEN 4 THEN ['/a.png', '/b.png'] ELSE [] END AS images
  FROM shown WHERE n >= 2)
"""
