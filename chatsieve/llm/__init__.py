"""Operators of a training-data pipeline: near-duplicates, scoring, packing, privacy, tokenization, binary output, fingerprints."""
