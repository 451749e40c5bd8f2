"""Slicing, augmentation, decomposition, kernels, solvers, metrics and reports."""
