"""Training-data operators: deduplication, filtering, scoring, formatting, packing, search."""
