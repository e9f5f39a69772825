"""Operators of the reconciliation engine."""
