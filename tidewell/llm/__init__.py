"""Training-data operators: filtering, deduplication, tokenisation, packing and sharding of documents."""
