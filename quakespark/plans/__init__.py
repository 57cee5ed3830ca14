"""Composite engines: driver loops and pipelines over the operators."""
