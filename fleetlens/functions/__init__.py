"""Column-level helpers and the two aggregations Spark has no scalable form of."""
