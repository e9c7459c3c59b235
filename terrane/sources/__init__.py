"""Source tables: catalog, Parquet, or derived from the test data."""
