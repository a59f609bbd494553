"""Training-data operators: tokenising, deduplication, decontamination, scoring, packing.

Nothing else in the package imports this folder; it can be removed as a whole.
"""
