"""Training-data operators: packing, tokenising, near-duplicates, filters, sharding."""
