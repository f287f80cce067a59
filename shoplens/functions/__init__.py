"""Column-level helpers; all built from ``pyspark.sql.functions`` (JVM side)."""
