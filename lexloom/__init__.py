"""A Spark-native engine for text corpora, lexicons and dated records."""
