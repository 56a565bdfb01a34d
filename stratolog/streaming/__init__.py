"""Streaming ingestion and background compaction."""
