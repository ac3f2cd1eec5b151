"""Compositions of operators into whole jobs, and the queries that exercise them."""
