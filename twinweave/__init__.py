"""Detection of code and template reuse between web projects, on Spark."""
