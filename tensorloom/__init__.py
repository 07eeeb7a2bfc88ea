"""Spark-first engine for correlation functions of named-axis complex tensors."""
