"""Training-data operators: deduplication, filters, scoring, mixing and formats."""
