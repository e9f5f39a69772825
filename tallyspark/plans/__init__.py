"""Plans of the reconciliation engine."""
