"""jobweave: a Spark-native analytics engine for hiring text."""
