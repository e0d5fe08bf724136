"""Training-data operators: near-dedup, sharding, packing, scans, classifiers, search and token output."""
