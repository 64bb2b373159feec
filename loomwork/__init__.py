"""A Spark-native engine for typed dataflow workflows."""
