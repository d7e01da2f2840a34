"""Incremental ingest of run rows."""
