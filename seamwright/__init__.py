"""seamwright: a Spark-native engine for indexing and querying versioned source repositories."""
