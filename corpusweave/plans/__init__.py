"""Whole plans: ingest, search and the query catalogue."""
