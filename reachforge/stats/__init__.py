"""Inference on sufficient statistics: aggregates are distributed, the small rest is NumPy on the driver."""
