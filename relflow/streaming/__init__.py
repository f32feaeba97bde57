"""Workflows over streams, a micro-batch at a time."""
