"""Relational operators: quality, slicing, aggregation, resampling, ordering, grading, metrics."""
