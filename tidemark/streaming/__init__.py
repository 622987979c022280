"""Structured Streaming forms of the ingest, alert and daily operators."""
