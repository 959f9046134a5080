"""Sketching, comparison, pruning and reordering of sketches."""
