"""Pipelines, the query registry and its SQL."""
