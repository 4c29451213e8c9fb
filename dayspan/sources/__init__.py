"""Readers, header cleaning and sinks."""
