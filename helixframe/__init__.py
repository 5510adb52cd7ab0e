"""Genomic variant annotation and model evaluation as Spark DataFrame functions."""
