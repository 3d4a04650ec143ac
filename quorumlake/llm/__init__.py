"""Operators for preparing training data; no other part of the package imports this one."""
