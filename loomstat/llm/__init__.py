"""Training-data operators: search, classifiers, sharding, deduplication, mixing, licences, tokenizers."""
