"""Structured Streaming variants of timeline operators."""
