"""Structured Streaming operators."""

