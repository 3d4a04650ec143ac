"""Queries."""
