"""Financial record reconciliation as Spark DataFrame plans."""
