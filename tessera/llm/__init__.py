"""Operators that prepare text corpora for model training."""
