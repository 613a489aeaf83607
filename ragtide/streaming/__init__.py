"""Incremental (Structured Streaming) form of the folder ingest."""
