"""Training-data operators: counting, scoring, deduplication, filtering and encoding of documents."""
