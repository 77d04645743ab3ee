"""Structured Streaming extension; not part of the batch engine's semantics."""
