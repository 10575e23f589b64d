"""korpusa: a Spark-native engine for document retrieval, structuring and corpus analytics."""

__version__ = "0.1.0"
