"""Column functions: positions, GTID sets, keys, hashes, statement predicates."""
