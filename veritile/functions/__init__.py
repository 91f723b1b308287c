"""Scalar column expressions and numpy kernels."""
