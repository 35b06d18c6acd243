"""Operators for preparing text corpora at scale; the rest of the package does not depend on them."""
