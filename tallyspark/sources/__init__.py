"""Sources of the reconciliation engine."""
