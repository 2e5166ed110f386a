"""Spark jobs for privacy-preserving association studies on variant-by-sample tables."""
