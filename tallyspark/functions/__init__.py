"""Functions of the reconciliation engine."""
