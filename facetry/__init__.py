"""Dataset characterisation on Spark."""
