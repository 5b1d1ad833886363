"""Scalar and feature-set functions, regular-expression dialect, folding."""
