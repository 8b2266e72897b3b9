"""Operators: design, derived columns, scans, tails, meta-analysis, reports."""
