"""Structured Streaming ingest of numbered batches with a keyed upsert per micro-batch."""
