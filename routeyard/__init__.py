"""Model-routing analytics as Spark DataFrame operators."""
