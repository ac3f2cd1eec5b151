"""Operators that a pipeline for training text needs."""
