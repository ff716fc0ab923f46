"""Streaming maintenance of an index."""
