"""Training-data operators: quality, contamination, copies, private data, formats, mixing, sharding."""
