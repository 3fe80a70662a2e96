"""Corpora as DataFrames, and tagger models in files."""
