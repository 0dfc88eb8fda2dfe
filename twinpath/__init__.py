"""Sequence-alignment analytics as Spark DataFrame operators."""
