"""Operators for training-data pipelines: formatting, encoding, filtering, near-copies, packing."""
