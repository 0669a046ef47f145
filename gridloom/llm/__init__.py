"""Operators that a large training-data pipeline needs, over tables of documents."""
