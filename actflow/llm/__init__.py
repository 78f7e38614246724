"""Training-data operators: scoring, deduplication, archives, packing, privacy."""
