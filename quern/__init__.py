"""quern: a Spark-native engine for document retrieval analytics."""
