"""Queries of the problems, one module each."""
