"""Training-data operators: sharding, packing, scans, deduplication, mixing, scoring and search."""
