"""Joins, aggregates and writes as DataFrame transforms."""
