"""Spark-first feature-barcode analytics."""
