"""The tables of the price store as explicit schemas, with their keys."""

from __future__ import annotations

TABLES = {
    "providers": "id string, domain string, name string, enabled boolean, default_currency string",
    "products": "id string, name string, brand string, product_name string, size string, active boolean",
    "brand": "id string, name string",
    "scrapes": "id string, provider_id string, url string, scraped_at timestamp, status string, capture_path string, product_count long, container_class string",
    "provider_products": "id string, provider_id string, name string, provider_product_url string, product_id string, brand_id string, last_seen_at timestamp",
    "provider_product_images": "id string, provider_product_id string, url string, position long, is_primary boolean",
    "provider_product_matches": "id string, provider_product_id string, product_id string, score double, status string",
    "provider_product_prices": "id string, provider_product_id string, scrape_id string, price double, currency string, price_text string, created timestamp",
}

#: Columns that are unique together. products: brand and size count as empty if null.
KEYS = {
    "providers": [["domain"]],
    "products": [["brand", "name", "size"]],
    "brand": [["name"]],
    "provider_products": [["provider_id", "provider_product_url"], ["provider_id", "name"]],
    "provider_product_images": [["provider_product_id", "url"]],
    "provider_product_matches": [["provider_product_id", "product_id"]],
    "provider_product_prices": [["provider_product_id", "scrape_id"]],
}

PRODUCT = "struct<name: string, price_text: string, price: double, url: string, images: array<string>, currency: string>"
CONTAINER = "struct<classes: array<string>, id: string, child_count: bigint>"
CAPTURE = f"url string, captured_at long, container {CONTAINER}, detected_cards long, products array<{PRODUCT}>"
