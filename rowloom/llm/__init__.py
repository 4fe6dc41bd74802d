"""Operators for training-data corpora: counting, deduplication, tokenising, filtering, sharding and mixing."""
