"""Structured Streaming forms of change tracking; an extension of the batch operators."""
