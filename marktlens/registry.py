"""The engine's own queries and their SQL, by name."""

from __future__ import annotations

from .plans import queries as q
from .plans.oracles import SQL

QUERIES = {
    "price_matrix": q.price_matrix,
    "matrix_pivot": q.matrix_pivot,
    "min_price_per_provider": q.matrix_cells,
    "provider_column_order": q.provider_column_order,
    "latest_price": q.latest_price,
    "cheapest_provider": q.cheapest_provider,
    "price_change_history": q.price_change_history,
    "history_summary": q.history_summary,
    "stream_price_changes": q.stream_price_changes,
    "match_brands": q.match_brands,
    "match_brands_summary": q.match_brands_summary,
    "brand_from_product": q.brand_from_product,
    "brand_coverage_top1": q.brand_coverage_top1,
    "missing_brands": q.missing_brands,
    "known_brands": q.known_brands,
    "unbranded": q.unbranded,
    "propose_unmatched": q.propose_unmatched,
    "dice_similarity_join": q.dice_similarity_join,
    "stored_pair_skip": q.stored_pair_skip,
    "greedy_assignment": q.greedy_assignment,
    "match_products_summary": q.match_products_summary,
    "relink_from_cache": q.relink_from_cache,
    "upsert_listings": q.upsert_listings,
    "image_sync": q.image_sync,
    "cascade_delete": q.cascade_delete,
    "import_brands": q.import_brands,
    "import_products": q.import_products,
    "delta_dedup": q.delta_dedup,
    "ensure_providers": q.ensure_providers,
    "normalize_name": q.normalize_name,
    "full_name": q.full_name,
    "strip_brand": q.strip_brand,
    "split_size": q.split_size,
    "find_size": q.find_size,
    "ascii_fold_products": q.ascii_fold_products,
    "ascii_fold_documents": q.ascii_fold_documents,
    "number_tokens": q.number_tokens,
    "parse_price": q.parse_price,
    "classify_price_text": q.classify_price_text,
    "detect_currency": q.detect_currency,
    "host_of": q.host_of,
    "extract_page": q.extract_page,
    "next_page": q.next_page,
    "iso8601": q.iso8601,
    "detect_grid": q.detect_grid,
    "diagnose_containers": q.diagnose_containers,
    "matrix_json": q.matrix_json,
    "greedy_conflicts": q.greedy_conflicts,
    "greedy_rounds": q.greedy_rounds,
    "store_matches": q.store_matches,
    "delete_unbranded": q.delete_unbranded,
    "csv_catalog": q.csv_catalog,
    "shop_products": q.shop_products,
    "shop_containers": q.shop_containers,
    "ingest_prices": q.ingest_prices,
    "ingest_summary": q.ingest_summary,
    "capture_files": q.capture_files,
    "poll_stalls": q.poll_stalls,
    "provider_scan": q.first_listing,
}

__all__ = ["QUERIES", "SQL"]
