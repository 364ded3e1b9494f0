"""lexmill: a Spark-native engine for document corpora."""
