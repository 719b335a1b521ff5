"""A Spark-native analytics engine for paged documents."""
