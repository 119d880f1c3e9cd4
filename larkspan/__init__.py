"""A PySpark-native engine for a compact SQL dialect over versioned Parquet tables."""
