"""Training-data operators: deduplication, language ID, tokenising, mixing, sharding, archives."""
