"""Incremental forms of the reductions."""
