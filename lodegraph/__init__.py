"""A Spark-native engine for code-knowledge analytics."""
