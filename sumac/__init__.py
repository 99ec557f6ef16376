"""Sumac: schema-driven tabular analytics expressed as plain Spark DataFrame plans."""
