"""Sentence-level evidence analytics as Spark DataFrame plans."""
