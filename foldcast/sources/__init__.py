"""Readers, writers and the layout of a run's outputs."""
