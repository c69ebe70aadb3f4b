"""Column-level functions (scalar expressions built from pyspark.sql.functions)."""
