"""Operators that prepare code and text collections for training."""
