"""Training-data operators: quality, duplicates, mixing, tokens, archives and search."""
