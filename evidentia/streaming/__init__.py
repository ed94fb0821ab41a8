"""Structured Streaming forms of ingest and curation."""
