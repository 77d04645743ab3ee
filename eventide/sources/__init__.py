"""Readers, sinks and the canonical views over the driver's tables."""
