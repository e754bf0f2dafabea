"""Scans, parsers of nested input, and sinks."""
