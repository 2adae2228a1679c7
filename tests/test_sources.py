"""Files in and out, streams, and the registered queries."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marktlens.operators import matrix
from marktlens.registry import QUERIES, SQL
from marktlens.schemas import CAPTURE, KEYS, TABLES
from marktlens.sources import files
from marktlens.streaming import flows

SMALL = "/root/testdata/sf0.001"
TABLE_NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_csv_imports(spark, tmp_path):
    (tmp_path / "p.csv").write_text('brand,name,size\n Quil ,"Amber, dry",40 ml\n,Plain,\nX,,5 ml\nQuil,"Amber, dry",40 ml\n')
    rows = files.read_products_csv(spark, str(tmp_path / "p.csv"))
    assert sorted(r.name for r in rows.collect()) == ["Plain", "Quil Amber, dry 40 ml", "Quil Amber, dry 40 ml"]
    there = spark.createDataFrame([("1", "Plain", "", "Plain", "", True)], TABLES["products"])
    assert sorted(r.id == "1" for r in files.import_products(there, rows).collect()) == [False, True]
    (tmp_path / "b.csv").write_text("anything\nNAME\n Quil \n\nTrill\n")
    brands = files.read_brands_csv(spark, str(tmp_path / "b.csv"))
    assert sorted(r.name for r in files.import_brands(spark.createDataFrame([("1", "Trill")], TABLES["brand"]), brands).collect()) == ["Quil", "Trill"]


def test_csv_exports(spark, tmp_path):
    products = spark.createDataFrame([("1", "", "Ñandú", "Été, 1", "50 ML", True), ("2", "", None, "Aa", None, True)], TABLES["products"])
    files.export_products(products, str(tmp_path / "p.csv"))
    assert (tmp_path / "p.csv").read_bytes().decode() == '﻿brand,product_name,size\n,aa,\nnandu,"ete, 1",50 ml\n'
    files.export_brands(spark.createDataFrame([("1", "Zoë"), ("2", "Ägir")], TABLES["brand"]), str(tmp_path / "b.csv"))
    assert (tmp_path / "b.csv").read_bytes().decode() == "﻿name\nagir\nzoe\n"
    cells = spark.createDataFrame([("1", "A", 631407.0), ("1", "B", 87.25), ("2", "A", 1.0)], "product_id string, provider_id string, price double")
    kept = matrix.rows(spark.createDataFrame([("1", "b"), ("2", "a")], "id string, name string"), cells)
    order = matrix.columns(spark.createDataFrame([("A", "a.com"), ("B", "b.com"), ("C", "c.com")], "id string, domain string"), kept)
    files.export_matrix(kept, order, str(tmp_path / "m.csv"))
    assert (tmp_path / "m.csv").read_bytes().decode() == "﻿Product,a.com,b.com,c.com\nb,631407,87.25,\n"


def capture(spark, at, names):
    products = [(n, "1.50", 1.5, None, ["b", "a"] if at % 2 else ["a", "b"], "EUR") for n in names]
    return spark.createDataFrame([("https://x.com/l", at, (["grid"], None, 2), len(names), products)], CAPTURE)


def test_captures_and_product_stream(spark, tmp_path):
    folder = str(tmp_path / "captures")
    for at, names in ((1, ["one", "two"]), (2, ["two", "three"])):
        files.write_captures(capture(spark, at, names), folder)
        flows.run_available(flows.product_stream(flows.capture_stream(spark, folder)), str(tmp_path / "out"), str(tmp_path / "state"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == at + 1
    assert sorted(p.name for p in (tmp_path / "captures" / "x.com").glob("*.json")) == ["capture-1.json", "capture-2.json"]
    assert '\n  "url": "https://x.com/l"' in (tmp_path / "captures" / "x.com" / "capture-1.json").read_text()
    assert files.read_captures(spark, folder).where("url = 'https://x.com/l'").count() == 2
    batches = []
    flows.run_available(flows.product_stream(flows.capture_stream(spark, folder)), "", str(tmp_path / "state2"), lambda df, n: batches.append(df.count()))
    assert sum(batches) == 3


def test_captures_without_host(spark, tmp_path):
    one = capture(spark, 7, ["a"]).withColumn("url", F.lit("no address"))
    assert files.write_captures(one, str(tmp_path / "c")) == 1 and (tmp_path / "c" / "capture-7.json").exists()
    assert files.read_captures(spark, str(tmp_path / "c")).first().captured_at == 7
    assert files.write_captures(one.limit(0), str(tmp_path / "none")) == 0


def test_ingest_stream(spark, tmp_path):
    """Captures stream into the store; each batch has its version, and a batch that comes again changes nothing."""
    sink, folder = flows.into_store(str(tmp_path / "store")), str(tmp_path / "in")
    for at, names in ((1, ["one", "two"]), (3601, ["two", "three"])):
        files.write_captures(capture(spark, at, names), folder)
        flows.run_available(flows.capture_stream(spark, folder), "", str(tmp_path / "state"), sink)
    store = flows.stored_tables(spark, str(tmp_path / "store"), 2)
    assert {n: t.count() for n, t in store.items()} == {"providers": 1, "scrapes": 2, "provider_products": 3, "provider_product_images": 6, "provider_product_prices": 3}
    before = {name: sorted(map(str, t.collect())) for name, t in store.items()}
    sink(capture(spark, 3601, ["two", "three"]), 1)
    assert {name: sorted(map(str, t.collect())) for name, t in flows.stored_tables(spark, str(tmp_path / "store"), 2).items()} == before
    polled = flows.start(flows.product_stream(flows.capture_stream(spark, folder)), str(tmp_path / "out"), str(tmp_path / "state2"), every="1 second")
    polled.processAllAvailable()
    polled.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_price_stream_over_batches(spark, tmp_path):
    for n, (price, at) in enumerate([(1.0, "2024-01-01"), (1.0, "2024-01-02"), (2.0, "2024-01-03")]):
        spark.createDataFrame([("k", price, "EUR", at, n)], "key string, price double, currency string, created string, id long").withColumn("created", F.to_timestamp("created")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(flows.CHANGE).parquet(str(tmp_path / "in"))
        flows.run_available(flows.price_changes(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2]


def test_pages_and_tables(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>\nx</p>")
    assert files.read_pages(spark, str(tmp_path / "a.html")).first().html == "<p>\nx</p>"
    spark.createDataFrame([("1", "Quil")], TABLES["brand"]).write.parquet(str(tmp_path / "brand"))
    assert files.read_table(spark, str(tmp_path), "brand").count() == 1
    for table, keys in KEYS.items():
        columns = {c.split()[0] for c in TABLES[table].split(", ")}
        assert all(set(k) <= columns for k in keys)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for name in TABLE_NAMES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return found


def same(a, b):
    show = lambda v: "" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    rows = lambda f: sorted(tuple(show(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    return sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in SQL:
        assert same(got, con.execute(SQL[name]).df())
