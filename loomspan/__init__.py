"""Spark-native engine for sequencing alignments and gene annotations."""
