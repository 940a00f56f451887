"""Spark-first operators for iterative data curation and batch algebra."""
