"""tidemark: a Spark-native versioned table engine and analytics library."""
