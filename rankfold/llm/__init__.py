"""Training-data operators: packing, archives, sharding, classification, secret scans, joins, search, BPE."""
