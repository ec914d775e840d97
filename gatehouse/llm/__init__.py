"""Operators for large training-data pipelines: fingerprints, dedup, quality, toxicity, PII, mixing, packing, chat."""
