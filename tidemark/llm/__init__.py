"""Operators for preparing text corpora for training.  Nothing outside this subpackage imports it."""
