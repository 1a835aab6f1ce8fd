"""Training-data operators: dedup, packing, scans, search, encoding, sharding, quality."""
