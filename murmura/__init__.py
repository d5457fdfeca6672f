"""Density-cluster analytics over evolving point sets, as PySpark DataFrame operators."""
