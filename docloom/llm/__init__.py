"""Operators for preparing training data: tokenisation, extraction, deduplication, sharding, packing."""
