"""Incremental form of the batch cleaning steps."""
