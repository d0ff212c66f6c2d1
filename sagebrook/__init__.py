"""A PySpark-native knowledge-retrieval and corpus engine."""
