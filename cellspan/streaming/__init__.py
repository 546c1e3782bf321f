"""Replication of mutation batches by Structured Streaming."""
