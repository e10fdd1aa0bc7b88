"""lodestar: a Spark-native document index and analytics engine."""
