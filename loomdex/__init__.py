"""A Spark-native engine that turns source files and documents into a queryable index."""
