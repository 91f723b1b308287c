"""Operators on DataFrames: scores, evaluation, batches, pixel stencils, blocks and matching."""
