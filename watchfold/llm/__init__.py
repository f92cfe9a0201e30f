"""Operators that prepare language-model training data: deduplication, redaction, quality, mixing and packing."""
