"""A Spark-native engine for statement analytics and training-data preparation."""
