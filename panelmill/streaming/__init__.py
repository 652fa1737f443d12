"""Streaming ingestion of the panel."""
