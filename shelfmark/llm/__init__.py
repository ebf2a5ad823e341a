"""Operators that prepare training data: tokens, mixing, filters and near-duplicate detection.

Nothing else in the library imports this subpackage.
"""
