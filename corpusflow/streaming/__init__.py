"""Structured Streaming jobs: session memory with expiry, and continuous ingestion."""
