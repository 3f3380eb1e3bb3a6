"""Incremental forms of the ingest and triage flows."""
