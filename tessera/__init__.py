"""Tessera: a Spark-first analytics engine for inference traces, metrics and text corpora."""
