"""Training-data operators: scoring, filtering, deduplication and packing of text corpora."""
