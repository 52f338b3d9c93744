"""Structured Streaming forms of ingest, duplicate search and live counts."""
