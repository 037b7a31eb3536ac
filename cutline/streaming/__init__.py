"""Structured Streaming forms of the per-key rules."""
