"""Training-data operators: extraction, deduplication, scoring, search, sharding, mixing."""
