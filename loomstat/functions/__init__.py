"""Scalar functions: distributions and a small expression language."""
