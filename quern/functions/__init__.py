"""Column functions: text, numerals, dates, hashes, scores."""
