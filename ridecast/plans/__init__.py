"""Composed flows and the query catalogue."""
