"""Relational operators: intervals, feature counts, coverage, minimizers, trees, alignment."""
