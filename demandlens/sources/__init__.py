"""Readers, the star-schema sales view, record validation and sinks."""
