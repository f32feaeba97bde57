"""Typed logical plans, the analysis that makes them, and their description."""
