"""Spark-first vector scoring, transaction analytics and corpus preparation."""

ABI_VERSION = 1
