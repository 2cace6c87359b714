"""Gristmill: Spark-native curation and auditing of text corpora."""
