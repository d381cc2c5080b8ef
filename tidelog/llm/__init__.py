"""Operators on text for training data: packing, leakage of evaluation texts, reading level."""
