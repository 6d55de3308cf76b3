"""Operators for training-data pipelines: filters, counts, rules, shards, packing and joins."""
