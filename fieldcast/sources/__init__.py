"""Readers for landed documents, and table sinks."""
