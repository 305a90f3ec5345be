"""Operators for large training corpora: tokens, mixing, duplicates, privacy, quality."""
