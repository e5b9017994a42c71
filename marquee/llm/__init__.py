"""Operators for text corpora and record linkage. Nothing else in the library imports this subpackage."""
