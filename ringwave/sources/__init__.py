"""Table schemas, the Parquet lake, the signal catalog and device tables."""
