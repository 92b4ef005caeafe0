"""Panel price analytics on Spark: DataFrame-first operators, sources, plans and queries."""
