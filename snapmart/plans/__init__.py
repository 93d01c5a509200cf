"""Compositions of the operators: monthly extraction, training, scoring, monitoring."""
