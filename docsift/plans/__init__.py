"""Compositions of operators: the query catalog, experiment matrix and SQL oracle texts."""
