"""Training-data operators: filtering, deduplication, sharding and tokenisation of text tables."""
