"""Training-data operators: near duplicates, fingerprints, extraction, packing,
quality, toxicity, language, mixing, sharding and token files."""
