"""Scans, sinks and ingest hygiene."""
