"""Readers, adapters and stored tables."""
