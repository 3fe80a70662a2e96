"""Segmentation and tagging of streams."""

from .apply import read_text_stream, word_counts, write_transformed

__all__ = ["read_text_stream", "word_counts", "write_transformed"]
