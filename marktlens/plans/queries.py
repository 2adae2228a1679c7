"""The registered queries: operators and use cases over the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prices as money
from ..functions import text as names
from ..functions import urls
from ..operators import brands as brand_ops
from ..operators import detect, history, matching, matrix, scans, store
from ..operators import ingest as ingestion
from ..schemas import TABLES
from ..session import fresh_folder, written
from ..sources import files
from ..streaming import flows
from . import domain as d
from . import shops

# Price matrix


def matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.cells(d.products(spark, sf_dir), d.provider_products(spark, sf_dir), matrix.latest_prices(d.prices(spark, sf_dir)))


def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.rows(d.products(spark, sf_dir), matrix_cells(spark, sf_dir))


def price_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix's cells with each row's name and number of providers."""
    return matrix.long_rows(d.products(spark, sf_dir), matrix_cells(spark, sf_dir))


def matrix_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix's rows as JSON."""
    return matrix.json_lines(matrix_rows(spark, sf_dir)).select("product_id", "json")


def matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix as lines of its CSV, in which order places the providers."""
    rows = written(matrix_rows(spark, sf_dir), "matrix-rows")
    return matrix.csv_lines(rows, matrix.columns(d.providers(spark, sf_dir), rows)).select("product_id", "line")


def provider_column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.columns(d.providers(spark, sf_dir), price_matrix(spark, sf_dir))


def latest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.latest_prices(d.prices(spark, sf_dir))


def cheapest_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.cheapest(matrix_cells(spark, sf_dir))


# History


def price_change_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.changes(d.observations(spark, sf_dir)).select("provider_product_id", "price", "created", "id")


def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = d.observations(spark, sf_dir)
    return history.summary(history.changes(seen), seen)


def stream_price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history from a stream of the events, with keyed state."""
    base = fresh_folder(spark, "stream")
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    seen = rows.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), F.floor(F.col("value") / 50).cast("double").alias("price"), F.lit("").alias("currency"), F.col("ts").alias("created"), F.col("event_id").alias("id"))
    out, state = f"{base}/out", f"{base}/state"
    flows.run_available(flows.price_changes(seen), out, state)
    return spark.read.schema(flows.CHANGE).parquet(out).select(F.col("key").alias("provider_product_id"), "price", "created", "id")


# Brands


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_ops.assign(d.provider_products(spark, sf_dir), d.products(spark, sf_dir), d.brands(spark, sf_dir))


def match_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir)


def match_brands_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_ops.summary(assigned(spark, sf_dir))


def brand_from_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).where("via = 'product'").select("id", "target")


def brand_coverage_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_ops.best_brand(d.provider_products(spark, sf_dir), d.brands(spark, sf_dir))


def missing_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    coverage = names.brand_coverage(F.col("name"), F.col("brand"))
    return brand_ops.missing(d.provider_products(spark, sf_dir), d.products(spark, sf_dir), d.providers(spark, sf_dir), coverage)


def known_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_ops.known_brands(d.brands(spark, sf_dir), d.products(spark, sf_dir))


def unbranded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_ops.unbranded(d.provider_products(spark, sf_dir), d.brands(spark, sf_dir), d.products(spark, sf_dir)).select("id", "name")


def propose_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals against a catalog that lacks its inactive products."""
    return brand_ops.proposals(d.provider_products(spark, sf_dir), d.products(spark, sf_dir).where("active"), d.brands(spark, sf_dir))


# Matching


def dice_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = d.catalog_listings(spark, sf_dir).select(names.compact(F.col("name")).alias("c"))
    right = d.products(spark, sf_dir).where("active").select(names.compact(F.col("name")).alias("c"))
    return matching.similar_names(left, right).withColumn("score", F.round("score", 6))


def stored_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of pairs: each listing with its own part, scored by the part's number."""
    part = d.source(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    return part.select(F.concat(F.lit("m-"), key).alias("id"), F.concat(F.lit("l-"), key).alias("provider_product_id"), key.alias("product_id"), (F.col("p_partkey") % 11 / 10).alias("score"), F.lit("pending").alias("status"))


def edges(spark: SparkSession, sf_dir: str, digits: int | None = None) -> DataFrame:
    return matching.candidates(d.catalog_listings(spark, sf_dir), d.products(spark, sf_dir), stored_matches(spark, sf_dir), digits)


def stored_pair_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New candidate pairs: stored ones are not computed again."""
    return edges(spark, sf_dir, digits=6)


def matches(spark: SparkSession, sf_dir: str) -> matching.Matches:
    return matching.Matches(d.catalog_listings(spark, sf_dir), d.products(spark, sf_dir), stored_matches(spark, sf_dir))


def greedy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners among new and stored edges."""
    return matches(spark, sf_dir).winners().withColumn("score", F.round("score", 6))


def match_products_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(spark, sf_dir)
    return matching.match_summary(None, stored_matches(spark, sf_dir), d.catalog_listings(spark, sf_dir), found.winners(), found.computed())


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with many rivals: a region's nations and the brands, scored by how often they meet in lineitem (in tenths, so ties abound)."""
    line, part, supplier, nation = (d.source(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    met = line.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    met = met.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    found = met.groupBy(F.col("n_regionkey").cast("string").alias("provider_id"), F.col("n_name").alias("provider_product_id"), F.col("p_brand").alias("product_id")).agg(F.sum("n").alias("n"))
    return found.select("provider_id", "provider_product_id", "product_id", (F.col("n") % 5 / 10 + 0.5).alias("score"))


def greedy_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-to-one assignment of conflicts() above the threshold."""
    return matching.assign(conflicts(spark, sf_dir).where(F.col("score") >= scans.MATCH_SCORE))


def greedy_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by distributed rounds."""
    return matching.assign(conflicts(spark, sf_dir).where(F.col("score") >= scans.MATCH_SCORE), most_edges=0)


def store_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after the pairs of conflicts() and its own were added: stored ones keep score and status."""
    pairs = conflicts(spark, sf_dir).select("provider_product_id", "product_id", "score")
    again = stored_matches(spark, sf_dir).select("provider_product_id", "product_id", F.lit(0.9).alias("score"))
    return ingestion.insert_matches(stored_matches(spark, sf_dir), pairs.unionByName(again)).select("provider_product_id", "product_id", "score", "status")


def relink_from_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache's matches after it alone has been assigned again."""
    stored = stored_matches(spark, sf_dir)
    winners = matching.assign(matching.with_provider(scans.above_threshold(stored), d.catalog_listings(spark, sf_dir)))
    return matching.confirmed(stored, winners).select("id", "provider_product_id", "product_id", "status")


# Store


def seen_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.provider_products(spark, sf_dir).select("provider_id", "name", F.concat(F.lit("/p/"), F.col("id")).alias("url"), F.lit(0).cast("long").alias("seen_at"))


def upsert_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = d.provider_products(spark, sf_dir).where("product_id is not null")
    known = store.first_of(known, ["provider_id", "name"], ["id"])
    return store.upsert_listings(known, seen_listings(spark, sf_dir)).select("id", "provider_id", "name", "url", "is_new")


def image_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = d.source(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("provider_product_id"), "p_partkey", "p_size")
    picture = lambda i: F.concat_ws("/", F.lit("img"), "provider_product_id", i.cast("string"))
    numbers = lambda n: F.slice(F.sequence(F.lit(0), F.lit(4)), F.lit(1), n)
    stored = part.select("provider_product_id", F.posexplode(F.transform(numbers((F.col("p_size") % 5).cast("int")), picture)).alias("position", "url"))
    stored = stored.withColumn("position", F.col("position").cast("long")).withColumn("is_primary", F.col("position") == 0)
    cards = part.select("provider_product_id", F.reverse(F.transform(numbers((F.col("p_partkey") % 5).cast("int")), picture)).alias("images"))
    return store.sync_images(stored, cards)


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in each table once the unlinked listings are gone."""
    listed = d.provider_products(spark, sf_dir)
    tables = {"provider_products": listed, "provider_product_prices": d.prices(spark, sf_dir)}
    left = store.cascade_delete(tables, listed.where("product_id is null").select("id"))
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in left.items()]
    return counts[0].unionByName(counts[1])


def delete_unbranded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in each table once the listings that none of a third of the brands covers are gone."""
    few = d.brands(spark, sf_dir).where("length(name) % 3 = 1")
    tables = {"provider_products": d.provider_products(spark, sf_dir), "provider_product_prices": d.prices(spark, sf_dir)}
    left = store.delete_unbranded(tables, few, d.products(spark, sf_dir).limit(0))
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in left.items()]
    return counts[0].unionByName(counts[1])


def csv_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as CSV, read back as catalog rows, and imported."""
    path = fresh_folder(spark, "csv")
    odd = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.col("p_name"), F.lit(', "new"'))).when(F.col("p_partkey") % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name"))
    rows = d.source(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(" ")).alias("brand"), odd.alias("name"), F.concat(F.col("p_size").cast("string"), F.lit(" ml")).alias("size"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    found = files.import_products(spark.createDataFrame([], TABLES["products"]), files.read_products_csv(spark, path))
    return found.select("brand", "product_name", "size", "name")


def import_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.import_brands(d.brands(spark, sf_dir), d.source(spark, sf_dir, "part").select(F.trim("p_brand").alias("name")))


def import_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active catalog after an import of all parts."""
    rows = store.trimmed_products(d.products(spark, sf_dir))
    rows = rows.withColumn("name", names.full_name(F.col("brand"), F.col("product_name"), F.col("size")))
    there = store.first_of(d.products(spark, sf_dir).where("active"), ["brand", "product_name", "size"], ["id"])
    return files.import_products(there, rows).select("brand", "product_name", "size", "name", "active")


def delta_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct products of a stream of cards; the order of images does not count."""
    e = d.source(spark, sf_dir, "events")
    name, value = F.concat_ws(" ", "event_type", (F.col("user_id") % 50).cast("string")), F.floor(F.col("value") / 50)
    pictures = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in ("ab", "ba", "c", "cb", "bc")]), (F.col("event_id") % 5 + 1).cast("int"))
    url = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("/u"), (F.col("event_id") % 3).cast("string")))
    cards = e.select(name.alias("name"), value.cast("string").alias("price_text"), value.cast("double").alias("price"), url.alias("url"), pictures.alias("images"), F.when(F.col("user_id") % 2 == 0, "EUR").alias("currency"))
    return store.delta(cards).select("name", "price_text", "price", "url", F.array_join(F.array_sort("images"), "").alias("images"), "currency")


def ensure_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = d.source(spark, sf_dir, "pages").select(urls.host_of(F.col("url")).alias("host"))
    return store.ensure_providers(d.providers(spark, sf_dir), hosts).select("id", "domain")


# Functions


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.source(spark, sf_dir, "part").withColumn("full", d.catalog_name())


def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.source(spark, sf_dir, "documents").select("doc_id", F.md5(names.normalize(F.col("text"))).alias("digest"))


def full_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ml "))).otherwise("")
    return part_names(spark, sf_dir).select("p_partkey", names.full_name(F.col("p_brand"), F.col("p_name"), size).alias("name"))


def strip_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a text that stands inside words in any case, and catalog names without their brand."""
    docs = d.source(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.md5(names.strip_brand(F.coalesce("text", F.lit("")), F.lit("eN"))).alias("name"))
    return docs.unionByName(part_names(spark, sf_dir).select(F.concat(F.lit("p"), "p_partkey").alias("id"), names.strip_brand(F.concat_ws(" ", F.upper("full"), "p_brand"), F.col("p_brand")).alias("name")))


def split_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).otherwise(F.col("full"))
    return part_names(spark, sf_dir).select("p_partkey", names.split_size(text).alias("s")).select("p_partkey", "s.name", "s.size")


def find_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" x"), F.col("p_size").cast("string"), F.lit(" ML spray")))
    return part_names(spark, sf_dir).select("p_partkey", names.size_found(text).alias("size"))


def ascii_fold_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.products_csv(d.products(spark, sf_dir))


def ascii_fold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.source(spark, sf_dir, "documents").select("doc_id", F.md5(names.ascii_fold(F.col("text"))).alias("digest"))


def money_text() -> Column:
    return F.concat(F.lit("AR$ "), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), F.lit(" x"), F.col("l_quantity").cast("int").cast("string"))


def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.source(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(money.number_tokens(money_text()), "|").alias("tokens"))


def parse_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written as 1.234,56 and read again."""
    written = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    return d.source(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", money.parse_price(written).alias("price"))


def classify_price_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 4
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    text = F.when(kind == 0, F.concat(F.lit("$ "), price)).when(kind == 1, F.concat(F.lit(" "), (F.col("p_size") + 100).cast("string"), F.lit(" $"))).when(kind == 2, F.concat(F.lit("Oferta "), (F.col("p_size") + 10).cast("string"))).otherwise(F.col("p_name"))
    found = money.classify_text(text)
    return d.source(spark, sf_dir, "part").select("p_partkey", F.get(found, F.lit(0))["value"].alias("value"), F.get(found, F.lit(0))["text"].alias("token"))


SHOWN = ("US$ 12", "AR$ 12", "12 €", "R$ 12", "$ 12", "Mars 12", "£12 or usd 12", "u$s 7, 8 eur", "BRL", "Eurasia")


def detect_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over documents with and without a price at their end."""
    shown = F.element_at(F.array(*map(F.lit, SHOWN)), (F.col("doc_id") % len(SHOWN) + 1).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 > 0, shown).otherwise(""))
    return d.source(spark, sf_dir, "documents").select("doc_id", money.detect_currency(text).alias("currency"))


def host_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.source(spark, sf_dir, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"))


def extract_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.source(spark, sf_dir, "pages").select("page_id", urls.page_number(F.col("url")).alias("page"), urls.has_param(F.col("url"), "page").alias("has_page"))


def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.coalesce(urls.page_number(F.col("url")), F.lit(1)) + 1
    return d.source(spark, sf_dir, "pages").select("page_id", urls.with_page(F.col("url"), "page", page).alias("next_url"))


def iso8601(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.source(spark, sf_dir, "events").select("event_id", urls.iso8601(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("at"))


# Grids


def detect_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products on the driver's own pages (articles without grids)."""
    grids = detect.detect_grids(d.source(spark, sf_dir, "pages").select("page_id", "html"))
    return detect.products_of(grids).select("page_id", "position", "name", "price_text", "price", "url", "currency")


def shop_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products on shop pages of five layouts."""
    grids = detect.detect_grids(shops.shop_pages(spark, sf_dir))
    return detect.products_of(grids).select("page_id", "position", "name", "price_text", "price", "url", "currency", F.array_join("images", "|").alias("images"))


def shop_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container chosen on each shop page."""
    grids = detect.detect_grids(shops.shop_pages(spark, sf_dir))
    return grids.select("page_id", F.array_join("container.classes", " ").alias("classes"), F.col("container.id").alias("container_id"), F.col("container.child_count").alias("child_count"))


def diagnose_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate containers of the shop pages, the densest first."""
    found = detect.candidate_containers(shops.shop_pages(spark, sf_dir))
    each = found.select("page_id", F.posexplode("candidates").alias("place", "c"))
    return each.select("page_id", "place", F.array_join("c.classes", " ").alias("classes"), "c.price_count", "c.div_count", F.round("c.density", 6).alias("density"), "c.selected")


def shop_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two captures of each shop page, an hour apart; in the later one the prices of odd pages are doubled."""
    pages = shops.shop_pages(spark, sf_dir)
    grids = detect.detect_grids(pages).join(pages.select("page_id", "url"), "page_id")
    later = F.transform("products", lambda p: p.withField("price", F.when(F.col("page_id") % 2 == 1, p["price"] * 2).otherwise(p["price"])))
    first = grids.select("url", F.lit(1_700_000_000).cast("long").alias("captured_at"), "container", "products")
    return first.unionByName(grids.select("url", F.lit(1_700_003_600).cast("long").alias("captured_at"), "container", later.alias("products")))


def ingested(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The store after the first captures, all of them, and all of them again."""
    captures = written(shop_captures(spark, sf_dir), "captures")
    tables = ingestion.empty_store(spark)
    for batch in (captures.where("captured_at = 1700000000"), captures, captures):
        tables = {name: written(t, name) for name, t in ingestion.ingest(tables, batch).items()}
    return tables


def ingest_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price history that the captures leave."""
    tables = ingested(spark, sf_dir)
    names = tables["provider_products"].select(F.col("id").alias("provider_product_id"), "name", "provider_id").join(tables["providers"].select(F.col("id").alias("provider_id"), "domain"), "provider_id")
    return tables["provider_product_prices"].join(names, "provider_product_id").select("domain", "name", "price", "currency", "price_text", F.unix_seconds("created").alias("at"))


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in each table after the captures."""
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in ingested(spark, sf_dir).items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures written as files, one each by host and time, and read back."""
    folder = fresh_folder(spark, "captures")
    shown = shop_captures(spark, sf_dir).where("captured_at = 1700000000").groupBy(urls.host_of(F.col("url")).alias("host")).agg(F.min_by(F.struct("url", "captured_at", "container", "products"), "url").alias("c")).select("c.*")
    files.write_captures(shown.withColumn("detected_cards", F.size("products").cast("long")).select("url", "captured_at", "container", "detected_cards", "products"), folder)
    back = files.read_captures(spark, folder).withColumn("file", F.regexp_extract(F.input_file_name(), "([^/]+/capture-[0-9]+[.]json)$", 1))
    return back.select("file", "url", "detected_cards", F.posexplode("products").alias("position", "p")).select("file", "url", "detected_cards", "position", "p.name", "p.price")


def poll_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls of each user's events, the value as the number of products: when growth has stalled three times."""
    polls = d.source(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("captured_at"), F.floor("value").cast("long").alias("n_products"))
    return flows.stalls(polls)


def first_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest provider's listings, a scan limited to one provider."""
    return scans.of_provider(d.provider_products(spark, sf_dir), "1").withColumn("nth", F.row_number().over(Window.partitionBy("provider_id").orderBy("id"))).select("id", "nth")
