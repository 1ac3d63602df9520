"""Operators for large training corpora: tokens, neighbours, packing, filters, duplicates and media columns."""
