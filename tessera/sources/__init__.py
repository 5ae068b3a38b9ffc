"""Readers, schemas, parsers and sinks."""
