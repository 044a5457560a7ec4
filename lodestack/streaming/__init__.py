"""Structured Streaming forms of what the library does as files, events and messages arrive."""
