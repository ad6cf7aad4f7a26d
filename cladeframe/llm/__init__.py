"""Training-data operators: deduplication, tokenisation, archives, packing, formatting and quality rules."""
