"""A Spark-native engine for document knowledge: ingest, retrieval, graph, analytics."""
