"""Readers of evidence formats as Spark relations."""
