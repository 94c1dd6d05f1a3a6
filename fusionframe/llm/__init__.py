"""Training-data operators: search, language, packing, URL, sharding, dedup, PII, toxicity."""
