"""A PySpark-native engine that answers `space.table` SQL over Parquet, versioned and row-store spaces."""
