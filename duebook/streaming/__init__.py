"""Structured Streaming versions of ingest, audit, retry state and metrics."""
