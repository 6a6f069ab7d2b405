"""Structured Streaming jobs: chunk ingest and live rules."""
