"""Column-level helpers and ordered-data primitives shared by the operators."""
