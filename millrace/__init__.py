"""millrace: a PySpark-native engine for knowledge-base retrieval and its relational surface."""
