"""Files in and out: CSV imports and exports, JSON captures, HTML pages."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, ascii_lower, collapse_ends, full_name
from ..functions.urls import capture_place
from ..operators.store import first_of, insert_new, new_id, trimmed_products
from ..schemas import CAPTURE, TABLES

BOM = "\ufeff"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the store, with its explicit schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def read_products_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows by position (brand, name, size) behind a header line; names built, nameless rows left out."""
    rows = spark.read.schema("brand string, product_name string, size string").csv(path, header=True, enforceSchema=True, multiLine=True, escape='"')
    rows = trimmed_products(rows)
    return rows.withColumn("name", full_name(F.col("brand"), F.col("product_name"), F.col("size")))


def read_brands_csv(spark: SparkSession, path: str) -> DataFrame:
    """Brand names, first column behind a header line; blank ones and a repeated header are left out."""
    rows = spark.read.schema("name string").csv(path, header=True, enforceSchema=True, multiLine=True, escape='"')
    return rows.select(collapse_ends(F.col("name")).alias("name")).where((F.col("name") != "") & (ascii_lower(F.col("name")) != "name"))


def import_products(products: DataFrame, rows: DataFrame) -> DataFrame:
    """products with the rows whose (brand, product_name, size) is new."""
    fresh = first_of(rows, ["brand", "product_name", "size"], ["name"])
    fresh = fresh.select(new_id(F.col("brand"), F.col("product_name"), F.col("size")).alias("id"), "name", "brand", "product_name", "size", F.lit(True).alias("active"))
    return insert_new(products, fresh, ["brand", "product_name", "size"])


def import_brands(brands: DataFrame, rows: DataFrame) -> DataFrame:
    """brands with the rows whose name is new."""
    return insert_new(brands, rows.select("name").distinct().select(new_id(F.col("name")).alias("id"), "name"), ["name"])


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """JSON captures, one object a file or a line."""
    return spark.read.schema(CAPTURE).option("recursiveFileLookup", True).json(folder, multiLine=True)


def write_captures(captures: DataFrame, folder: str) -> int:
    """Each capture as indented JSON at <folder>/<host>/capture-<captured_at>.json, in the folder itself without a host.

    Tasks write their own files through Arrow's file systems; a repeated task
    writes the same files again. Returns how many there are.
    """
    rows = captures.select(capture_place(folder, F.col("url")).alias("place"), "captured_at", F.to_json(F.struct(*[c for c in captures.columns]), {"ignoreNullFields": "false"}).alias("json"))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for place, at, text in frame.itertuples(index=False):
                fs, path = FileSystem.from_uri(place if "://" in place or place.startswith("file:") else f"file://{os.path.abspath(place)}")
                fs.create_dir(path, recursive=True)
                with fs.open_output_stream(f"{path}/capture-{at}.json", compression=None) as out:
                    out.write(json.dumps(json.loads(text), indent=2, ensure_ascii=False).encode())
            yield pd.DataFrame({"n": [len(frame)]})

    return rows.mapInPandas(each, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML files as (url, html)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def csv_field(x) -> F.Column:
    return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def products_csv(products: DataFrame) -> DataFrame:
    """(brand, product_name, size, line) folded to ASCII; order by the first three to export."""
    folded = [F.coalesce(ascii_fold(F.col(c)), F.lit("")).alias(c) for c in ("brand", "product_name", "size")]
    rows = products.select(*folded)
    return rows.withColumn("line", F.concat_ws(",", *[csv_field(F.col(c)) for c in ("brand", "product_name", "size")]))


def brands_csv(brands: DataFrame) -> DataFrame:
    rows = brands.select(ascii_fold(F.col("name")).alias("name"))
    return rows.withColumn("line", csv_field(F.col("name")))


def write_lines(header: str, lines: DataFrame, path: str) -> None:
    """One CSV file with a byte order mark from ordered lines (column line), streamed through the driver.

    The file goes where Hadoop's file systems reach; the driver holds one
    partition of lines at a time.
    """
    spark = lines.sparkSession
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(f"{BOM}{header}\n".encode()))
        for row in lines.select("line").toLocalIterator():
            out.write(bytearray(f"{row[0]}\n".encode()))
    finally:
        out.close()


def export_products(products: DataFrame, path: str) -> None:
    write_lines("brand,product_name,size", products_csv(products).orderBy("brand", "product_name", "size"), path)


def export_brands(brands: DataFrame, path: str) -> None:
    write_lines("name", brands_csv(brands).orderBy("name"), path)


def export_matrix(rows: DataFrame, order: DataFrame, path: str) -> None:
    """The price matrix: products by lower-cased name, providers in their order."""
    from ..operators.matrix import csv_lines, in_order

    domains = [r[0] for r in order.orderBy("position").select(csv_field(F.col("domain"))).collect()]  # one header line
    write_lines(",".join(["Product", *domains]), in_order(csv_lines(rows, order)), path)
