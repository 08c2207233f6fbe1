"""Pagelight: a Spark-first engine for document-reading analytics."""
