"""Structured Streaming forms of ingest, order guard, resample, sections and append."""
