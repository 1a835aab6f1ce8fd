"""Scalar functions: column expressions where Spark has them, Arrow-batched UDFs where it hasn't."""
