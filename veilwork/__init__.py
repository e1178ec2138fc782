"""Reversible pseudonymization of text corpora and wide tables as Spark jobs."""

__version__ = "0.1.0"
