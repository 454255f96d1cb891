"""A Spark-native SQL engine over typed-header CSV folders and Parquet tables."""
