"""Spark-native word segmentation, sequence-set lookup and part-of-speech tagging."""
