"""Cross-venue market-data analytics as Spark DataFrame operators."""
