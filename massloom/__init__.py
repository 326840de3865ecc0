"""Spark-native analytics for mass-spectrometry and similar signal data."""
