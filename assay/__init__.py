"""Spark-native preparation, auditing and evaluation of labelled media-detection data."""
