"""Cleaning, windows, fidelity, features, models, metrics, resampling and policies."""
