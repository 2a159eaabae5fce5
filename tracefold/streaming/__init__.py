"""Structured Streaming forms of analysis progress and file ingestion."""
