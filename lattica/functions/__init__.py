"""Scalar functions and array kernels."""
