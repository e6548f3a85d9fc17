"""Structured Streaming operators; each has a batch twin in ``operators``."""
