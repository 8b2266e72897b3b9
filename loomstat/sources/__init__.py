"""Readers and writers: clinical tables, genotype sets, result tables, configuration."""
