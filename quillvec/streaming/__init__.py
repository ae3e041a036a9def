"""Structured Streaming ingest and shard snapshots."""
