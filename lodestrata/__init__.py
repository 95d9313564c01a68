"""Spark-first engine for evidence-backed, bitemporal observation tables and training-data pipelines."""
