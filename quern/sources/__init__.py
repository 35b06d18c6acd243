"""Readers that turn files and raw records into typed tables."""
