"""Training-data preparation: dedup, sharding, mixing, classification, extraction, tokenizing, search."""
