"""Training-data operators: text encoding, search, filtering, deduplication, mixing, media and sharding."""
