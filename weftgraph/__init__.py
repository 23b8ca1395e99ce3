"""Incremental multi-pattern graph analytics on Spark."""
