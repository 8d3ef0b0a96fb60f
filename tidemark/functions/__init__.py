"""Durations, clocks and column helpers."""
