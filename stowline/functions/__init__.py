"""Column functions: names, sizes, digests, report text."""
