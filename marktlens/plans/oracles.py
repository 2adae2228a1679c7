"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions.text import FOLDS, LONG_FOLDS, LOWER, QUOTES, REMOVED, UPPER
from .domain import SQL as DOMAIN
from .queries import SHOWN
from .shops import SQL as SHOPS


def over_domain(query: str, more: str = "") -> str:
    return f"WITH {DOMAIN.strip()}{', ' + more if more else ''} {query}"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def fold(x: str) -> str:
    """ASCII folding as nested SQL calls."""
    accents, plain = "".join(FOLDS.values()), "".join(k * len(v) for k, v in FOLDS.items())
    capital = [(a.upper(), p) for a, p in zip(accents, plain, strict=True) if len(a.upper()) == 1 and a.upper() != a]
    one = UPPER + accents + "".join(a for a, _ in capital) + QUOTES
    to = LOWER + plain + "".join(p for _, p in capital) + "'" * len(QUOTES)
    out = f"translate({x}, {quoted(one + REMOVED)}, {quoted(to)})"
    for a, b in LONG_FOLDS.items():
        out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    return out


NUMBER = "(CASE WHEN price = floor(price) THEN price::BIGINT::VARCHAR ELSE price::VARCHAR END)"
ASSIGNED = """
ids AS (SELECT name AS owned, max(id) AS owned_id FROM brand GROUP BY 1),
assigned AS (
  SELECT v.id, v.brand_id AS current, CASE WHEN v.product_id IS NOT NULL THEN ids.owned_id ELSE best.b.id END AS target,
         CASE WHEN CASE WHEN v.product_id IS NOT NULL THEN ids.owned_id ELSE best.b.id END IS NULL THEN 'unmatched' WHEN v.product_id IS NOT NULL THEN 'product' ELSE 'fuzzy' END AS via
  FROM provider_products v LEFT JOIN products p ON p.id = v.product_id AND p.active LEFT JOIN ids ON ids.owned = trim(p.brand) LEFT JOIN best ON best.name = v.name)
"""
COUNTS = "counts AS (SELECT provider_id, count(*) AS n_cells FROM kept GROUP BY 1), cols AS (SELECT id AS provider_id, domain, coalesce(n_cells, 0) AS n_cells, row_number() OVER (ORDER BY coalesce(n_cells, 0) DESC, domain, id) AS position FROM providers LEFT JOIN counts ON counts.provider_id = id)"
CHANGES = "SELECT *, lag(price) OVER w AS before, row_number() OVER w AS nth FROM observations WINDOW w AS (PARTITION BY provider_product_id ORDER BY created, id)"
COMPACT = "array_to_string(list_sort(list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')), '')"
GRAMS = """
l AS (SELECT DISTINCT {left} AS c FROM part),
r AS (SELECT DISTINCT {right} AS c FROM products WHERE active),
u AS (SELECT c FROM l UNION SELECT c FROM r),
g AS (SELECT c, t, row_number() OVER (PARTITION BY c, t) AS o FROM (SELECT c, unnest(list_transform(range(1, length(c)), lambda i: substr(c, i, 2))) AS t FROM u)),
k AS (SELECT x.c AS a, y.c AS b, count(*) AS n FROM g x JOIN g y ON x.t = y.t AND x.o = y.o WHERE x.c IN (FROM l) AND y.c IN (FROM r) AND x.c <> y.c GROUP BY ALL),
pairs AS (SELECT a, b, 2.0 * n / (strlen(a) + strlen(b) - 2) AS score FROM k WHERE 2.0 * n / (strlen(a) + strlen(b) - 2) >= 0.6 UNION ALL SELECT c, c, 1.0 FROM l WHERE c IN (FROM r))
""".format(left=COMPACT.format("concat_ws(' ', p_name, p_size::VARCHAR, 'ml -', p_brand)"), right=COMPACT.format("name"))
STORED = "stored AS (SELECT 'm-' || p_partkey AS id, 'l-' || p_partkey AS provider_product_id, p_partkey::VARCHAR AS product_id, (p_partkey % 11) / 10 AS score FROM part)"
LISTED = f"listed AS (SELECT 'l-' || p_partkey AS id, {COMPACT.format(chr(99) + 'oncat_ws(' + quoted(' ') + ', p_name, p_size::VARCHAR, ' + quoted('ml -') + ', p_brand)')} AS c FROM part)"
MONEY = "'AR$ ' || l_extendedprice::DECIMAL(12,2) || ' x' || l_quantity::INTEGER"

CONFLICTS = """
conflicts AS (SELECT n_regionkey::VARCHAR AS provider_id, n_name AS provider_product_id, p_brand AS product_id, count(*) % 5 / 10 + 0.5 AS score
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)"""
#: Of edges e, numbered from the best within each provider: one after the other, with what is claimed so far.
CLAIMS = """
w AS (
  SELECT provider_id, nth, provider_product_id, product_id, score, true AS won, [provider_product_id] AS ls, [product_id] AS ps FROM e WHERE nth = 1
  UNION ALL
  SELECT e.provider_id, e.nth, e.provider_product_id, e.product_id, e.score, NOT list_contains(ls, e.provider_product_id) AND NOT list_contains(ps, e.product_id),
         CASE WHEN list_contains(ls, e.provider_product_id) OR list_contains(ps, e.product_id) THEN ls ELSE list_append(ls, e.provider_product_id) END,
         CASE WHEN list_contains(ls, e.provider_product_id) OR list_contains(ps, e.product_id) THEN ps ELSE list_append(ps, e.product_id) END
  FROM w JOIN e ON e.provider_id = w.provider_id AND e.nth = w.nth + 1)"""
GREEDY = f"""WITH RECURSIVE {CONFLICTS},
e AS (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY score DESC, provider_product_id, product_id) AS nth FROM conflicts WHERE score >= 0.6),
{CLAIMS} SELECT provider_id, provider_product_id, product_id, score FROM w WHERE won"""
FRESH = f"SELECT listed.id AS provider_product_id, p.id AS product_id, score FROM pairs JOIN listed ON listed.c = pairs.a JOIN products p ON p.active AND {COMPACT.format('p.name')} = pairs.b WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.provider_product_id = listed.id AND s.product_id = p.id)"
MATCHED = f"""WITH RECURSIVE {DOMAIN.strip()}, {GRAMS.strip()}, {STORED}, {LISTED}, fresh AS ({FRESH}),
every AS (SELECT substr(provider_product_id, 3)::BIGINT % 20 AS shop, * FROM (SELECT * FROM fresh UNION ALL SELECT provider_product_id, product_id, score::DOUBLE FROM stored WHERE score >= 0.6)),
e AS MATERIALIZED (SELECT shop::VARCHAR AS provider_id, provider_product_id, product_id, score, row_number() OVER (PARTITION BY shop ORDER BY score DESC, provider_product_id, product_id) AS nth FROM every),
{CLAIMS}"""

SQL = {
    "price_matrix": over_domain("SELECT k.product_id, p.name, k.provider_id, k.price, k.n_providers FROM kept k JOIN products p ON p.id = k.product_id"),
    "matrix_pivot": over_domain(
        f"SELECT w.product_id, concat_ws(',', w.name, string_agg(coalesce({NUMBER}, ''), ',' ORDER BY cols.position)) AS line FROM (SELECT DISTINCT product_id, p.name FROM kept JOIN products p ON p.id = product_id) w CROSS JOIN cols LEFT JOIN kept ON kept.product_id = w.product_id AND kept.provider_id = cols.provider_id GROUP BY w.product_id, w.name",
        COUNTS,
    ),
    "min_price_per_provider": over_domain("SELECT * FROM cells"),
    "provider_column_order": over_domain("SELECT * FROM cols", COUNTS),
    "latest_price": over_domain("SELECT * FROM latest"),
    "cheapest_provider": over_domain("SELECT *, rank() OVER (PARTITION BY product_id ORDER BY price) AS place FROM cells"),
    "price_change_history": over_domain(f"SELECT provider_product_id, price, created, id FROM ({CHANGES}) WHERE nth = 1 OR price <> before"),
    "history_summary": over_domain(f"SELECT count(*) AS n_observed, count(DISTINCT provider_product_id) AS n_listings, count(*) FILTER (nth = 1 OR price <> before) AS n_stored FROM ({CHANGES})"),
    "stream_price_changes": over_domain(f"SELECT provider_product_id, price, created, id FROM ({CHANGES}) WHERE nth = 1 OR price <> before"),
    "match_brands": over_domain("SELECT *, current IS DISTINCT FROM target AS changed FROM assigned", ASSIGNED),
    "match_brands_summary": over_domain("SELECT count(*) FILTER (via = 'product') AS n_product, count(*) FILTER (via = 'fuzzy') AS n_fuzzy, count(*) FILTER (via = 'unmatched') AS n_unmatched, count(*) FILTER (current IS DISTINCT FROM target) AS n_updated FROM assigned", ASSIGNED),
    "brand_from_product": over_domain("SELECT id, target FROM assigned WHERE via = 'product'", ASSIGNED),
    "brand_coverage_top1": over_domain("SELECT name, b.id AS brand_id, b.brand AS brand FROM best"),
    "missing_brands": over_domain(
        "SELECT v.id, coalesce(s.domain, '') AS domain, v.name, p.brand FROM provider_products v JOIN products p ON p.id = v.product_id LEFT JOIN providers s ON s.id = v.provider_id WHERE trim(p.brand) <> '' AND NOT list_has_all(string_split_regex(lower(v.name), '[^\\p{L}\\p{N}]+'), list_filter(string_split_regex(lower(p.brand), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''))"
    ),
    "known_brands": over_domain("SELECT DISTINCT name FROM (SELECT trim(name) AS name FROM brand UNION SELECT trim(brand) FROM products) WHERE name <> ''"),
    "unbranded": over_domain(
        "SELECT v.id, v.name FROM provider_products v WHERE NOT EXISTS (SELECT 1 FROM kb JOIN tok ON tok.name = v.name AND list_has_all(tok.t, kb.t))",
        "kb AS (SELECT DISTINCT list_filter(string_split_regex(lower(p_brand), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS t FROM part)",
    ),
    "propose_unmatched": over_domain(
        """SELECT provider_product_id, source_name, brand, product_name, size, concat_ws(' ', nullif(brand, ''), product_name, size) AS name FROM (
             SELECT *, row_number() OVER (PARTITION BY lower(brand), lower(product_name), size ORDER BY provider_product_id) AS nth FROM (
               SELECT v.id AS provider_product_id, v.name AS source_name, coalesce(best.b.brand, '') AS brand, trim(regexp_extract(trim(replace(v.name, coalesce(best.b.brand, chr(1)), '')), '^(.*) [0-9]+ ml$', 1)) AS product_name, regexp_extract(v.name, '([0-9]+ ml)$', 1) AS size
               FROM provider_products v LEFT JOIN best ON best.name = v.name WHERE product_id IS NULL) x
             WHERE lower(concat_ws(' ', nullif(brand, ''), product_name, size)) NOT IN (SELECT lower(name) FROM products WHERE active)) WHERE nth = 1"""
    ),
    "dice_similarity_join": over_domain("SELECT a, b, round(score, 6) AS score FROM pairs", GRAMS),
    "stored_pair_skip": over_domain(f"SELECT provider_product_id, product_id, round(score, 6) AS score FROM ({FRESH})", f"{GRAMS}, {STORED}, {LISTED}"),
    "greedy_assignment": f"{MATCHED} SELECT provider_id, provider_product_id, product_id, round(score, 6) AS score FROM w WHERE won",
    "match_products_summary": f"{MATCHED} SELECT (SELECT count(*) FROM fresh) AS n_computed, (SELECT count(*) FROM stored) AS n_stored, (SELECT count(*) FROM listed) AS n_listings, (SELECT count(*) FROM w WHERE won) AS n_matched",
    "matrix_json": over_domain("SELECT product_id, '{\"product_id\":\"' || product_id || '\",\"name\":\"' || p.name || '\",\"prices\":[' || string_agg('{\"provider_id\":\"' || provider_id || '\",\"price\":' || price::VARCHAR || '}', ',' ORDER BY provider_id) || ']}' AS json FROM kept JOIN products p ON p.id = product_id GROUP BY product_id, p.name"),
    "greedy_conflicts": GREEDY,
    "greedy_rounds": GREEDY,
    "store_matches": f"WITH {CONFLICTS}, {STORED} SELECT provider_product_id, product_id, score::DOUBLE AS score, 'pending' AS status FROM stored UNION ALL SELECT provider_product_id, product_id, score, 'pending' FROM conflicts",
    "delete_unbranded": over_domain(
        "SELECT 'provider_products' AS table_name, count(*) AS n FROM lefts UNION ALL SELECT 'provider_product_prices', count(*) FROM prices WHERE provider_product_id IN (SELECT id FROM lefts)",
        "lefts AS (SELECT v.id FROM provider_products v WHERE EXISTS (SELECT 1 FROM btok JOIN tok ON tok.name = v.name WHERE length(btok.name) % 3 = 1 AND list_has_all(tok.t, btok.t)))",
    ),
    "csv_catalog": "SELECT DISTINCT p_brand AS brand, n AS product_name, p_size || ' ml' AS size, concat_ws(' ', p_brand, n, p_size || ' ml') AS name FROM (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN p_name || ', \"new\"' ELSE p_name END AS n FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 <> 0)",
    "shop_products": f"WITH {SHOPS} SELECT page_id, position, name, price_text, price, url, currency, array_to_string(images, '|') AS images FROM grids",
    "shop_containers": f"WITH {SHOPS} SELECT page_id, 'goods list' || layout AS classes, 'g' || page_id AS container_id, n AS child_count FROM grids GROUP BY ALL",
    "diagnose_containers": f"""WITH {SHOPS}, d AS (SELECT DISTINCT page_id, layout, n, CASE layout WHEN 0 THEN 2 * n WHEN 1 THEN n WHEN 2 THEN 2 * n WHEN 3 THEN 4 * n ELSE 2 * n END + 1 AS divs FROM grids)
        SELECT page_id, 0 AS place, 'goods list' || layout AS classes, n AS price_count, divs AS div_count, round(n / divs, 6) AS density, true AS selected FROM d
        UNION ALL SELECT page_id, 1, 'page', n, divs + 3, round(n / (divs + 3), 6), false FROM d""",
    "ingest_prices": f"""WITH {SHOPS} SELECT 'shop' || layout || '.test' AS domain, name, price, coalesce(currency, '') AS currency, price_text, 1700000000 AS at FROM grids
        UNION ALL SELECT 'shop' || layout || '.test', name, 2 * price, coalesce(currency, ''), price_text, 1700003600 FROM grids WHERE page_id % 2 = 1""",
    "ingest_summary": f"""WITH {SHOPS} SELECT 'providers' AS table_name, count(DISTINCT layout) AS n FROM grids UNION ALL SELECT 'scrapes', 2 * count(DISTINCT page_id) FROM grids UNION ALL SELECT 'provider_products', count(*) FROM grids
        UNION ALL SELECT 'provider_product_images', coalesce(sum(len(images)), 0)::BIGINT FROM grids UNION ALL SELECT 'provider_product_prices', count(*) + count(*) FILTER (page_id % 2 = 1) FROM grids""",
    "capture_files": f"""WITH {SHOPS}, f AS (SELECT layout, min(page_url) AS page_url FROM grids GROUP BY 1)
        SELECT 'shop' || layout || '.test/capture-1700000000.json' AS file, page_url AS url, n AS detected_cards, position, name, price FROM grids JOIN f USING (layout, page_url)""",
    "poll_stalls": """WITH p AS (SELECT user_id::VARCHAR AS url, event_id AS captured_at, floor(value)::BIGINT AS n_products FROM events),
        g AS (SELECT *, coalesce(n_products > max(n_products) OVER (PARTITION BY url ORDER BY captured_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS grew FROM p),
        r AS (SELECT *, count(*) FILTER (grew) OVER (PARTITION BY url ORDER BY captured_at) AS run FROM g)
        SELECT url, captured_at, n_products, row_number() OVER (PARTITION BY url, run ORDER BY captured_at) - 1 AS n_stalled, row_number() OVER (PARTITION BY url, run ORDER BY captured_at) > 3 AS stopped FROM r""",
    "relink_from_cache": over_domain("SELECT id, provider_product_id, product_id, CASE WHEN score >= 0.6 THEN 'confirmed' ELSE 'pending' END AS status FROM stored", STORED),
    "upsert_listings": over_domain(
        """SELECT coalesce(k.id, substr(sha256(s.provider_id || chr(31) || s.name), 1, 15)) AS id, s.provider_id, s.name, s.url, k.id IS NULL AS is_new
           FROM (SELECT provider_id, name, min('/p/' || id) AS url FROM provider_products GROUP BY ALL) s
           LEFT JOIN (SELECT provider_id, name, min(id) AS id FROM provider_products WHERE product_id IS NOT NULL GROUP BY ALL) k ON k.provider_id = s.provider_id AND k.name = s.name"""
    ),
    "image_sync": """
        WITH s AS (SELECT p_partkey::VARCHAR AS p, unnest(range(0, p_size % 5))::BIGINT AS i FROM part),
        c AS (SELECT p_partkey::VARCHAR AS p, unnest(range(0, p_partkey % 5))::BIGINT AS i, p_partkey % 5 AS n FROM part)
        SELECT coalesce(s.p, c.p) AS provider_product_id, 'img/' || coalesce(s.p, c.p) || '/' || coalesce(s.i, c.i) AS url, coalesce(n - 1 - c.i, s.i)::BIGINT AS position, coalesce(n - 1 - c.i, s.i) = 0 AS is_primary,
               CASE WHEN c.p IS NULL THEN 'delete' WHEN s.p IS NULL THEN 'insert' WHEN n - 1 - c.i = s.i THEN 'keep' ELSE 'update' END AS action
        FROM s FULL JOIN c ON s.p = c.p AND s.i = c.i""",
    "cascade_delete": over_domain("SELECT 'provider_products' AS table_name, count(*) AS n FROM provider_products WHERE product_id IS NOT NULL UNION ALL SELECT 'provider_product_prices', count(*) FROM prices WHERE provider_product_id NOT IN (SELECT id FROM provider_products WHERE product_id IS NULL)"),
    "import_brands": over_domain("SELECT id, name FROM brand UNION ALL SELECT substr(sha256(p_brand), 1, 15), p_brand FROM (SELECT DISTINCT trim(p_brand) AS p_brand FROM part) WHERE p_brand NOT IN (SELECT name FROM brand)"),
    "import_products": over_domain("SELECT DISTINCT brand, product_name, size, name, true AS active FROM products"),
    "delta_dedup": "SELECT DISTINCT event_type || ' ' || user_id % 50 AS name, floor(value / 50)::BIGINT::VARCHAR AS price_text, floor(value / 50)::DOUBLE AS price, CASE WHEN event_id % 3 > 0 THEN '/u' || event_id % 3 END AS url, ['ab', 'ab', 'c', 'bc', 'bc'][event_id % 5 + 1] AS images, CASE WHEN user_id % 2 = 0 THEN 'EUR' END AS currency FROM events",
    "ensure_providers": "WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS domain FROM pages) SELECT s_suppkey::VARCHAR AS id, s_name AS domain FROM supplier UNION ALL SELECT substr(sha256(domain), 1, 15), domain FROM h WHERE domain <> '' AND domain NOT IN (SELECT s_name FROM supplier)",
    "normalize_name": "SELECT doc_id, md5(array_to_string(list_sort(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')), ' ')) AS digest FROM documents",
    "full_name": "SELECT p_partkey, concat_ws(' ', nullif(trim(p_brand), ''), nullif(trim(p_name), ''), CASE WHEN p_size % 2 = 0 THEN p_size || ' ml' END) AS name FROM part",
    "strip_brand": r"SELECT 'd' || doc_id AS id, md5(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[eE][nN]', ' ', 'g'), '\s+', ' ', 'g'))) AS name FROM documents UNION ALL SELECT 'p' || p_partkey, trim(regexp_replace(regexp_replace(concat_ws(' ', upper(concat_ws(' ', p_brand, p_name, p_size::VARCHAR, 'ml')), p_brand), '(?i)' || p_brand, ' ', 'g'), ' +', ' ', 'g')) FROM part",
    "split_size": "SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size || ' ml' END AS size FROM part WHERE p_partkey % 3 <> 2 UNION ALL SELECT p_partkey, concat_ws(' ', p_brand, p_name), p_size || ' ml' FROM part WHERE p_partkey % 3 = 2",
    "find_size": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size || ' ML' END AS size FROM part",
    "ascii_fold_products": over_domain("SELECT lower(brand) AS brand, lower(product_name) AS product_name, lower(size) AS size, lower(concat_ws(',', brand, product_name, size)) AS line FROM products"),
    "ascii_fold_documents": f"SELECT doc_id, md5({fold('text')}) AS digest FROM documents",
    "number_tokens": f"SELECT l_orderkey, l_linenumber, array_to_string(regexp_extract_all({MONEY}, '[0-9]+(?:[.,''][0-9]+)*'), '|') AS tokens FROM lineitem",
    "parse_price": "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM lineitem",
    "classify_price_text": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_retailprice::DECIMAL(12,2)::DOUBLE WHEN 1 THEN p_size + 100 END::DOUBLE AS value, CASE p_partkey % 4 WHEN 0 THEN p_retailprice::DECIMAL(12,2)::VARCHAR WHEN 1 THEN (p_size + 100)::VARCHAR END AS token FROM part",
    "detect_currency": f"""SELECT doc_id, CASE WHEN contains(t, 'US$') OR contains(t, 'U$S') OR contains(t, 'USD') THEN 'USD' WHEN contains(t, 'AR$') OR contains(t, 'ARS') THEN 'ARS' WHEN contains(t, '€') OR contains(t, 'EUR') THEN 'EUR'
        WHEN contains(t, '£') OR contains(t, 'GBP') THEN 'GBP' WHEN contains(t, 'R$') OR contains(t, 'BRL') THEN 'BRL' END AS currency
        FROM (SELECT doc_id, upper(coalesce(text, '') || CASE WHEN doc_id % 3 > 0 THEN {list(SHOWN)}[doc_id % {len(SHOWN)} + 1] ELSE '' END) AS t FROM documents)""",
    "host_of": "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages",
    "extract_page": "SELECT page_id, try_cast(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS BIGINT) AS page, regexp_matches(url, '[?&]page=') AS has_page FROM pages",
    "next_page": "SELECT page_id, regexp_replace(regexp_replace(b, '[?&]page=[0-9]+', CASE WHEN contains(b, '&') THEN '?' ELSE '' END), '[?]&', '?') || CASE WHEN contains(regexp_replace(b, '[?]page=[0-9]+$', ''), '?') THEN '&' ELSE '?' END || 'page=' || coalesce(try_cast(nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS BIGINT), 1) + 1 || coalesce(regexp_extract(url, '(#.*)$', 1), '') AS next_url FROM (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS b FROM pages)",
    "iso8601": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.000Z' AS at FROM events",
    "provider_scan": over_domain("SELECT id, row_number() OVER (ORDER BY id) AS nth FROM provider_products WHERE provider_id = '1'"),
}
