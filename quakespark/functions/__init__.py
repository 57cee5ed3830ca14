"""Scalar functions as Column expressions, and numeric kernels."""
