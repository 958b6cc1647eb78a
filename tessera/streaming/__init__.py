"""Keyed state over time, in batch and as streams."""
